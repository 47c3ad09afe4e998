"""Is the k-mer composition at each read cycle biased?"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.stats import gamma_tail
from strandloom.operators.kmers import counted
from strandloom.operators.stats import gamma_fit, kl_divergence, shares
from strandloom.sources.shared import cut

CELL = ["sample", "read", "strand", "pos"]


def kmer_cycle_counts(pairs: DataFrame, k: int, seqs: tuple[str, ...] = ("seq_1", "seq_2")) -> DataFrame:
    """sample, read (read1, read2), strand (fwd, rev), pos, kmer, n; rev counts the reverse complement at the same place."""
    ends = F.array(*(F.struct(F.lit(f"read{i}").alias("read"), F.col(seq).alias("seq")) for i, seq in enumerate(seqs, 1)))
    reads = pairs.select("sample", F.explode(ends).alias("end")).select("sample", "end.read", "end.seq")
    return _both_strands(counted(reads, "seq", k), k)


def cycle_counts_of_texts(texts: DataFrame, seq: str, k: int, length: int, codes: np.ndarray | None = None) -> DataFrame:
    """As ``kmer_cycle_counts``, of texts (sample, seq) cut into consecutive reads of a length: read1, read2 and so on in turn.

    codes: what bytes stand for (``kmers.letter_codes``).
    """
    found = counted(texts.select("sample", seq), seq, k, length=length, codes=codes)
    return _both_strands(found.withColumn("read", F.when(F.col("second"), "read2").otherwise("read1")), k)


def _both_strands(rows: DataFrame, k: int) -> DataFrame:
    # A k-mer has one reverse complement, so the counts of one strand are those of the other.
    strands = F.explode(F.create_map(F.lit("fwd"), "kmer", F.lit("rev"), "rc")).alias("strand", "kmer")
    return rows.select("sample", "read", "pos", "n", strands).select(*CELL, "kmer", "n").withColumn("K", F.lit(k))


def merge_counts(*parts: DataFrame, sample: str | None = None) -> DataFrame:
    """The sum of counts; with sample, all samples as one of that name. Parts of unlike K raise an error when rows are read."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    if sample is not None:
        every = every.withColumn("sample", F.lit(sample))
    out = every.groupBy(*CELL, "kmer").agg(F.sum("n").alias("n"), F.min("K").alias("K"), F.max("K").alias("_most"))
    kinds = out.agg(F.min("K").alias("_low"), F.max("_most").alias("_high"))  # one row, of what is summed already
    same = F.when(F.col("_low") == F.col("_high"), F.col("K")).otherwise(F.raise_error(F.lit("mismatched values of K")).cast("int"))
    return out.crossJoin(F.broadcast(kinds)).withColumn("K", same).drop("_most", "_low", "_high")


def distributions(counts: DataFrame) -> DataFrame:
    """counts with the share p of each k-mer at its place."""
    return shares(counts, "n", CELL)


def global_distribution(counts: DataFrame) -> DataFrame:
    """kmer, p over all reads, strands, places and samples; at most 4^k rows."""
    sums = counts.groupBy("kmer").agg(F.sum("n").alias("n"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("total")))).select("kmer", (F.col("n") / F.col("total")).alias("p"))


def against_global(counts: DataFrame, overall: DataFrame) -> DataFrame:
    """sample, read, pos, kld of the forward strand at each place against the global distribution."""
    forward = distributions(counts).where("strand = 'fwd'")
    return kl_divergence(forward.join(overall.withColumnRenamed("p", "q"), "kmer"), "p", "q", ["sample", "read", "pos"])


def score_sample(counts: DataFrame) -> DataFrame:
    """sample, read, pos, kld, pval of a single sample, by a gamma fit over all its places."""
    places = against_global(counts, global_distribution(counts))
    fit = gamma_fit(places, "kld")
    return places.crossJoin(F.broadcast(fit)).select("sample", "read", "pos", "kld", gamma_tail(F.col("kld"), F.col("k"), F.col("theta")).alias("pval"))  # one row


def score_samples(counts: DataFrame) -> DataFrame:
    """sample, read, pos, kldGlobal, pvalGlobal, kldPosition, pvalPosition of several samples against their sum."""
    counts = cut(counts, "counts")  # a small table, which is read several times
    every = merge_counts(counts, sample="all")
    one = against_global(counts, global_distribution(every)).withColumnRenamed("kld", "kldGlobal")
    forward = distributions(counts).where("strand = 'fwd'")
    pool = distributions(every).where("strand = 'fwd'").select("read", "pos", "kmer", F.col("p").alias("q"))
    two = kl_divergence(forward.join(pool, ["read", "pos", "kmer"]), "p", "q", ["sample", "read", "pos"])
    both = cut(one.join(two.withColumnRenamed("kld", "kldPosition"), ["sample", "read", "pos"]), "places")
    overall = gamma_fit(both, "kldGlobal").select(F.col("k").alias("kG"), F.col("theta").alias("thetaG"))  # one row
    by_place = gamma_fit(both, "kldPosition", ["read", "pos"]).select("read", "pos", F.col("k").alias("kP"), F.col("theta").alias("thetaP"))
    tested = both.crossJoin(F.broadcast(overall)).join(by_place, ["read", "pos"])
    tail = lambda place, s: gamma_tail(F.col(f"kld{place}"), F.col(f"k{s}"), F.col(f"theta{s}")).alias(f"pval{place}")
    return tested.select("sample", "read", "pos", "kldGlobal", tail("Global", "G"), "kldPosition", tail("Position", "P"))
