"""FASTQ, single and paired, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.strings import trimmed
from strandloom.sources.lines import numbered_lines

FIELDS = ("id", "seq", "id2", "qual")


def _must(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value, F.lit("nothing")))).cast("string"))


def parse_fastq(numbered: DataFrame) -> DataFrame:
    """file, read_no (from 0), id (without @), seq, id2 (without +), qual of every record of lines (file, line_no, value).

    Records are framed by line numbers, never by their marks, as @ is a legal quality. Missing marks and records of
    fewer than four lines raise an error when rows are read. An empty line at the end is no record.
    """
    lines = numbered.withColumn("value", trimmed(F.col("value")))
    slot = F.pmod("line_no", F.lit(4))
    field = [F.max(F.when(slot == i, F.col("value"))).alias(name) for i, name in enumerate(FIELDS)]
    sizes = [F.count("*").alias("n"), F.max(F.length("value")).alias("longest")]
    records = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("read_no")).agg(*field, *sizes)
    first = _must(F.col("id").startswith("@") & (F.col("n") == 4), F.col("id"), "no record of four lines with @")
    third = _must(F.col("id2").startswith("+"), F.col("id2"), "no + in the third line")
    without = lambda c, name: F.substring(c, F.lit(2), F.length(name)).alias(name)
    return records.where("NOT (n < 4 AND longest = 0)").select("file", "read_no", without(first, "id"), "seq", without(third, "id2"), "qual")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every record of FASTQ files, as parse_fastq has it."""
    return parse_fastq(numbered_lines(spark, path))


def pair_reads(one: DataFrame, two: DataFrame, limit: int | None = None) -> DataFrame:
    """read_no and id_1, seq_1, id2_1, qual_1, id_2, ... of the pairs of two files; unequal numbers of records raise an error."""
    named = [reads.select("read_no", *(F.col(f).alias(f"{f}_{i}") for f in FIELDS)) for i, reads in ((1, one), (2, two))]
    both = named[0].join(named[1], "read_no", "full")
    unequal = F.raise_error(F.lit("the files have unequal numbers of records")).cast("string")
    whole = F.when(F.col("seq_1").isNotNull() & F.col("seq_2").isNotNull(), F.col("seq_1")).otherwise(unequal)
    both = both.withColumn("seq_1", whole)
    return both if limit is None else both.where(F.col("read_no") < limit)


def read_fastq_pairs(spark: SparkSession, path1: str, path2: str, limit: int | None = None) -> DataFrame:
    return pair_reads(read_fastq(spark, path1), read_fastq(spark, path2), limit)


def fastq_text(id: Column, seq: Column, id2: Column, qual: Column) -> Column:
    """A record as four lines."""
    return F.concat_ws("\n", F.concat(F.lit("@"), id), seq, F.concat(F.lit("+"), F.coalesce(id2, F.lit(""))), qual)


def write_fastq(reads: DataFrame, path: str, suffix: str = "", compression: str | None = "gzip", order: str = "read_no") -> None:
    """Write records sorted by read_no as text part files, gzipped by default; suffix picks columns such as id_1."""
    fields = [F.col(f"{f}{suffix}") for f in FIELDS]
    writer = reads.orderBy(order).select(fastq_text(*fields).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)
