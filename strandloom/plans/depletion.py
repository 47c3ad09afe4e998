"""Split read pairs by whether they share a k-mer with a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.kmers import kmers, kmers_among, sampled
from strandloom.operators.table import counted

K = 25


def reference_kmers(reference: DataFrame, seq: str = "seq", k: int = K, seed: int = 0, probability: float = 1.0) -> DataFrame:
    """Distinct kmer of both strands of the reference, of a sample of its windows if probability is below 1."""
    rows = kmers(reference.select(F.col(seq).alias("seq"), F.xxhash64(seq).alias("of")), "seq", k, positions=True, both_strands=True)
    drawn = sampled(rows, seed, probability, "of", "pos")
    return drawn.select(F.explode(F.array("kmer", "rc")).alias("kmer")).distinct()


def hits(pairs: DataFrame, members: DataFrame, k: int = K, seqs: tuple[str, ...] = ("seq_1", "seq_2"), key: str = "read_no") -> DataFrame:
    """Distinct keys of the pairs with a k-mer of either mate among the members."""
    ends = F.explode(F.array(*(F.col(seq) for seq in seqs))).alias("seq")
    return kmers_among(pairs.select(key, ends), "seq", k, members).select(key).distinct()


def marked(
    pairs: DataFrame, reference: DataFrame, *, k: int = K, seqs: tuple[str, ...] = ("seq_1", "seq_2"), key: str = "read_no", seed: int = 0, probability: float = 1.0
) -> DataFrame:
    """pairs with hit: whether a mate has a k-mer of the reference."""
    found = hits(pairs, reference_kmers(reference, k=k, seed=seed, probability=probability), k, seqs, key)
    found = found.select(F.col(key).alias("_hit"))
    return pairs.join(found, pairs[key].eqNullSafe(found["_hit"]), "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_hit")


def deplete(pairs: DataFrame, reference: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(kept, tossed): pairs without and with a k-mer of the reference; options as of ``marked``."""
    both = marked(pairs, reference, **options)
    return both.where(~F.col("hit")).drop("hit"), both.where("hit").drop("hit")


def counts(pairs: DataFrame, reference: DataFrame, **options) -> DataFrame:
    """hit, n, percent."""
    return counted(marked(pairs, reference, **options), "hit")
