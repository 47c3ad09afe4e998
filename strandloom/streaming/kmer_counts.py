"""Running k-mer counts of a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.kmers import kmers


def stream_spectrum(reads: DataFrame, seq: str, k: int) -> DataFrame:
    """kmer, n of a streaming DataFrame, for the output modes complete and update."""
    return kmers(reads.select(seq), seq, k, canonical=True).groupBy("kmer").agg(F.count("*").alias("n"))


def stream_windowed(reads: DataFrame, seq: str, k: int, time: str, window: str, late: str) -> DataFrame:
    """window, kmer, n by event time; rows later than late are given up, so that state stays bounded."""
    rows = kmers(reads.withWatermark(time, late).select(time, seq), seq, k, canonical=True)
    return rows.groupBy(F.window(time, window), "kmer").agg(F.count("*").alias("n"))
