"""Pileups in long form: one row (sample, chrom, pos, symbol, n) for each symbol seen at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.strings import indels
from strandloom.operators.cigar import UNMAPPED, counted


def pileup(alignments: DataFrame, mapq_of_unmapped: int = 55) -> DataFrame:
    """Symbols of all reads but those that are unmapped and of low mapping quality too."""
    return counted(kept(alignments, mapq_of_unmapped), "pileup", ["sample", "chrom"]).withColumnRenamed("allele", "symbol")


def kept(alignments: DataFrame, mapq_of_unmapped: int = 55) -> DataFrame:
    return alignments.where(~((F.col("flag").bitwiseAND(F.lit(UNMAPPED)) != 0) & (F.col("mapq") < mapq_of_unmapped)))


def indel_symbols(alignments: DataFrame, mapq_of_unmapped: int = 55) -> DataFrame:
    """The symbols of ``pileup`` that are insertions or deletions; bases are never made."""
    return counted(kept(alignments, mapq_of_unmapped), "indels", ["sample", "chrom"]).withColumnRenamed("allele", "symbol")


def places(alignments: DataFrame, mapq_of_unmapped: int = 55) -> DataFrame:
    """chrom, pos of ``pileup``, each once; symbols and samples are never told apart."""
    return counted(kept(alignments, mapq_of_unmapped), "places", ["chrom"]).select("chrom", "pos")


def pooled(symbols: DataFrame) -> DataFrame:
    """chrom, pos, symbol, n over all samples."""
    return symbols.groupBy("chrom", "pos", "symbol").agg(F.sum("n").alias("n"))


def pseudo_alleles(symbols: DataFrame, by: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """by, total, alleles (distinct symbols) of each place."""
    return symbols.where("n > 0").groupBy(*by).agg(F.sum("n").alias("total"), F.count_distinct("symbol").alias("alleles"))


def with_shares(symbols: DataFrame) -> DataFrame:
    """symbols with total, alleles and pooled n of the place, the sample's own total there, p and q.

    All windows share the shuffle by (chrom, pos).
    """
    place, at = ["chrom", "pos"], F.sum("n")
    out = symbols.where("n > 0").repartition(*place)
    out = out.withColumn("pool_n", at.over(Window.partitionBy(*place, "symbol"))).withColumn("pool_total", at.over(Window.partitionBy(*place))).withColumn("total", at.over(Window.partitionBy(*place, "sample")))
    out = out.withColumn("pool_alleles", F.size(F.collect_set("symbol").over(Window.partitionBy(*place))))
    return out.withColumn("p", F.col("n") / F.col("total")).withColumn("q", F.col("pool_n") / F.col("pool_total"))


def divergences(symbols: DataFrame) -> DataFrame:
    """One row for each (chrom, pos, sample): kld of the sample against the pool, totals, alleles, shares, counts, indels."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col("n"))), F.lit(0)).alias(s)
    return with_shares(symbols).groupBy("chrom", "pos", "sample").agg(
        F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kld"), F.first("total").alias("total"), F.first("pool_total").alias("pool_total"), F.first("pool_alleles").alias("pool_alleles"), F.count("*").alias("alleles"),
        F.sort_array(F.collect_list("p"), asc=False).alias("shares"), *map(count, "ACGTN"), indels(F.collect_list(F.struct("symbol", "n"))).alias("indels"),
    )
