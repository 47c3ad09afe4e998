"""BED, TSV, gene lists and the JSON of counts and gamma models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.intervals import merge_regions
from strandloom.operators.table import genes_from

COUNTS = "K long, sample string, read1 struct<fwd:array<array<bigint>>,rev:array<array<bigint>>>, read2 struct<fwd:array<array<bigint>>,rev:array<array<bigint>>>"
GAMMA = "map<string,struct<N:bigint,k:double,theta:double>>"


def read_tsv(spark: SparkSession, path: str, header: bool = True, columns: list[str] = ()) -> DataFrame:
    """A tab-separated file of texts without quoting; a column of columns that is not there raises ValueError."""
    df = spark.read.option("sep", "\t").option("quote", "").option("escape", "").csv(path, header=header, inferSchema=False).na.fill("")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no column {missing[0]}")
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def read_bed(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    """chrom, start, stop (half-open) of a BED file, by default with overlapping and touching regions merged."""
    raw = spark.read.option("sep", "\t").schema("chrom string, start bigint, stop bigint").csv(path)
    return merge_regions(raw) if merged else raw


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    return genes_from(read_tsv(spark, path))


def read_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Long counts (K, sample, read, strand, pos, kmer, n) of JSON files, without zeros; kmer is a code."""
    doc = spark.read.schema(COUNTS).option("multiLine", True).json(path)
    out = None
    for read in ("read1", "read2"):
        for strand in ("fwd", "rev"):
            at = doc.select("K", "sample", F.posexplode(f"{read}.{strand}").alias("pos", "row")).select("K", "sample", F.lit(read).alias("read"), F.lit(strand).alias("strand"), F.col("pos").cast("bigint"), F.posexplode("row").alias("kmer", "n"))
            out = at if out is None else out.unionByName(at)
    return out.where("n <> 0").withColumn("kmer", F.col("kmer").cast("bigint"))


DISTRIBUTIONS = COUNTS.replace("bigint", "double").replace("sample string", "sample string, global array<double>")


def read_distributions(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Distributions (K, sample, read, strand, pos, kmer, p) and the global ones (sample, kmer, p) of JSON files, without zeros."""
    doc = spark.read.schema(DISTRIBUTIONS).option("multiLine", True).json(path)
    out = None
    for read in ("read1", "read2"):
        for strand in ("fwd", "rev"):
            at = doc.select("K", "sample", F.posexplode(f"{read}.{strand}").alias("pos", "row"))
            at = at.select("K", "sample", F.lit(read).alias("read"), F.lit(strand).alias("strand"), F.col("pos").cast("bigint"), F.posexplode("row").alias("kmer", "p"))
            out = at if out is None else out.unionByName(at)
    overall = doc.select("sample", F.posexplode("global").alias("kmer", "p"))
    return tuple(df.where("p <> 0").withColumn("kmer", F.col("kmer").cast("bigint")) for df in (out, overall))


def read_gamma(spark: SparkSession, path: str) -> DataFrame:
    """context, N, k, theta of a JSON object keyed by context."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", GAMMA)).alias("context", "m")).select("context", F.col("m.N").alias("N"), F.col("m.k").alias("k"), F.col("m.theta").alias("theta"))
