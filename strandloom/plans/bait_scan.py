"""Where in a genome do the k-mers of baits occur?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.intervals import coalesce_runs
from strandloom.operators.kmers import kmers, kmers_among

K = 27


def bait_index(baits: DataFrame, name: str = "name", seq: str = "seq", k: int = K) -> DataFrame:
    """Distinct kmer, bait of both strands of the baits."""
    rows = kmers(baits.select(F.col(name).alias("bait"), F.col(seq).alias("seq")), "seq", k, both_strands=True)
    return rows.select("bait", F.explode(F.array("kmer", "rc")).alias("kmer")).distinct()


def bait_hits(genome: DataFrame, baits: DataFrame, *, name: str = "name", seq: str = "seq", k: int = K) -> DataFrame:
    """chrom, lo, hi, bait: runs of positions whose k-mers belong to a bait, 0-based and closed, hi at the last base."""
    index = bait_index(baits, name, seq, k)
    sequences = genome.select(F.col(name).alias("chrom"), F.col(seq).alias("seq"))
    places = kmers_among(sequences, "seq", k, index.select("kmer").distinct(), positions=True)
    found = places.join(index, "kmer")
    return coalesce_runs(found, by=["chrom", "bait"], width=k).select("chrom", "lo", "hi", "bait")
