"""Writers: TSV tables, JSON of counts and gamma models, matrices of counts by k-mer and cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.kmers import decode


def write_tsv(df: DataFrame, path: str, header: bool = True, one_file: bool = False) -> None:
    """Tab-separated values without quoting; one_file only for results that are small, as it is one task."""
    (df.coalesce(1) if one_file else df).write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def gamma_json(models: DataFrame) -> DataFrame:
    """One row value: the JSON object {context: {N, k, theta}}; there are at most 4096 contexts."""
    pairs = models.agg(F.array_sort(F.collect_list(F.struct("context", F.struct("N", "k", "theta").alias("m")))).alias("all"))
    return pairs.select(F.to_json(F.map_from_entries("all")).alias("value"))


def dense(counts: DataFrame, k: int) -> Column:
    """Helper: an array of 4^k numbers from (kmer, n) pairs."""
    at = F.map_from_entries(F.collect_list(F.struct("kmer", "n")))
    return F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), lambda i: F.coalesce(at[i.cast("bigint")], F.lit(0)))


def counts_json(counts: DataFrame, k: int, kind: str = "bigint") -> DataFrame:
    """sample, value: the JSON of each sample's counts with dense arrays by position."""
    by_pos = counts.groupBy("sample", "read", "strand", "pos").agg(dense(counts, k).alias("row"))
    rows = by_pos.groupBy("sample", "read", "strand").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]).alias("rows"))
    pick = lambda read, strand: F.coalesce(F.first(F.when((F.col("read") == read) & (F.col("strand") == strand), F.col("rows")), ignorenulls=True), F.array().cast(f"array<array<{kind}>>")).alias(strand)
    end = lambda read: F.struct(pick(read, "fwd"), pick(read, "rev")).alias(read)
    return rows.withColumn("rows", F.col("rows").cast(f"array<array<{kind}>>")).groupBy("sample").agg(F.struct(F.lit(k).alias("K"), F.first("sample").alias("sample"), end("read1"), end("read2")).alias("doc")).select("sample", F.to_json("doc").alias("value"))


def distributions_json(shares: DataFrame, overall: DataFrame, k: int) -> DataFrame:
    """sample, value: the JSON of each sample's distributions (p by place) with the global one as a dense array."""
    counts = counts_json(shares.select("sample", "read", "strand", "pos", "kmer", F.col("p").alias("n")), k, "double")
    every = overall.select("kmer", F.col("p").alias("n")).agg(dense(None, k).alias("global"))
    kinds = "K long, sample string, " + ", ".join(f"read{i} struct<fwd:array<array<double>>,rev:array<array<double>>>" for i in (1, 2))
    doc = counts.withColumn("doc", F.from_json("value", kinds)).crossJoin(F.broadcast(every))  # one row crossed
    parts = [F.col("doc.K"), F.col("doc.sample"), F.col("global"), F.col("doc.read1"), F.col("doc.read2")]
    return doc.select("sample", F.to_json(F.struct(*parts)).alias("value"))


def matrix(values: DataFrame, k: int, value: str, length1: int, length2: int, total: DataFrame | None = None) -> DataFrame:
    """kmer and a column for each read, position and strand (L0f, L0r, ..., R0f, ...) over all 4^k k-mers, absent ones 0.

    total: (kmer, p), which adds the column global.
    """
    names = [f"{end}{i}{s}" for end, n in (("L", length1), ("R", length2)) for i in range(n) for s in "fr"]
    name = F.concat(F.when(F.col("read") == "read1", "L").otherwise("R"), F.col("pos").cast("string"), F.substring("strand", 1, 1))
    wide = values.withColumn("_name", name).groupBy("kmer").pivot("_name", names).agg(F.sum(value))
    out = values.sparkSession.range(4**k).withColumnRenamed("id", "kmer").join(wide, "kmer", "left").fillna(0)
    if total is not None:
        out = out.join(total.select("kmer", F.col("p").alias("global")), "kmer", "left").fillna(0, ["global"])
    return out.withColumn("kmer", decode(F.col("kmer"), k))
