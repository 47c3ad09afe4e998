"""GTF annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = r'([^\s";]+)\s+("[^"]*"|[^;"\s]+)\s*(?:;|$)'


def parse_gtf(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of GTF lines: eight fixed fields and attrs, the attributes in order, repeated keys included.

    Comments are left out; a line that is no row (a blank one too) raises an error when rows are read. A point means
    null for score and frame; quotes of attribute values are taken off.
    """
    f = F.split(F.regexp_replace(value, "\r$", ""), "\t")
    good = (F.size(f) == 9) & f[3].rlike(r"^\d+$") & f[4].rlike(r"^\d+$") & f[5].rlike(r"^(\.|\d+(\.\d+)?([eE][-+]?\d+)?)$") & f[6].rlike(r"^[-+.]$") & f[7].rlike(r"^[.012]$") & f[8].rlike(rf"^\s*({_ATTRIBUTE}\s*)*$")
    comment = F.col(value).startswith("#")  # left out, but a filter above may be tried first
    checked = F.when(good, f).when(comment, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("no GTF row: "), F.col(value))).cast("array<string>"))
    pair = F.transform(F.regexp_extract_all(F.col("f")[8], F.lit(_ATTRIBUTE), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _ATTRIBUTE, 1).alias("key"), F.regexp_replace(F.regexp_extract(x, _ATTRIBUTE, 2), '^"|"$', "").alias("value")))
    part = lambda i: F.col("f")[i]
    return lines.where(~comment).select(checked.alias("f")).select(
        part(0).alias("seqname"), part(1).alias("source"), part(2).alias("feature"), part(3).cast("bigint").alias("start"), part(4).cast("bigint").alias("end"), part(5).try_cast("double").alias("score"),
        part(6).alias("strand"), part(7).try_cast("int").alias("frame"), pair.alias("attrs"),
    )


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def attribute(key: str, attrs: Column | None = None) -> Column:
    """The last value of a key, null if there is none."""
    found = F.filter(F.col("attrs") if attrs is None else attrs, lambda a: a["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def genes(gtf: DataFrame, features: list[str] = ("gene",)) -> DataFrame:
    """chrom, lo, hi, gene_id, gene_name of the features that are protein coding or do not say what they are."""
    kept = gtf.where(F.col("feature").isin(*features)).where(F.coalesce(attribute("gene_type"), F.lit("protein_coding")) == "protein_coding")
    return kept.select(F.col("seqname").alias("chrom"), F.col("start").alias("lo"), F.col("end").alias("hi"), attribute("gene_id").alias("gene_id"), attribute("gene_name").alias("gene_name"))
