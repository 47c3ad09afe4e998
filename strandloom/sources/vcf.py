"""VCF as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind, id, number, type, description, text of the ## lines; a line without a structure has only its text."""
    body = F.col(value)
    named = lambda key: F.nullif(F.regexp_extract(body, rf'[<,]{key}=("[^"]*"|[^,>]*)', 1), F.lit(""))
    return lines.where(body.startswith("##")).select(
        F.regexp_extract(body, "^##([^=]*)=", 1).alias("kind"), named("ID").alias("id"), named("Number").alias("number"), named("Type").alias("type"), F.regexp_replace(named("Description"), '^"|"$', "").alias("description"), F.regexp_extract(body, "^##[^=]*=(.*)$", 1).alias("text")
    )


def check_header(header: DataFrame) -> DataFrame:
    """INFO and FORMAT lines whose properties are not in the order ID, Number, Type, Description."""
    return header.where(F.col("kind").isin("INFO", "FORMAT") & ~F.col("text").rlike(r"^<ID=[^,]+,Number=[^,]+,Type=[^,]+,Description="))


def parse_vcf(lines: DataFrame, samples: list[str], value: str = "value") -> DataFrame:
    """chrom, pos (1-based), id, ref, alts, qual, filters, info, format, samples (name, fields) of the data lines.

    A point means null or empty; an info flag has the value null; dropped trailing fields of a sample are null. A line
    with another number of columns raises an error when rows are read.
    """
    f, width = F.split(F.regexp_replace(value, "\r$", ""), "\t"), 9 + len(samples) if samples else 8
    left_out = F.col(value).startswith("#") | (F.length(value) == 0)  # said here too, as a filter above may be tried first
    checked = F.when(F.size(f) == width, f).when(left_out, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("no VCF row: "), F.col(value))).cast("array<string>"))
    part = lambda i: F.col("f")[i]
    known = lambda c: F.nullif(c, F.lit("."))
    many = lambda c, mark: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, mark))
    pairs = F.transform(F.filter(many(part(7), ";"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["k"] == p["k"])))
    keys = many(part(8), ":") if samples else F.array().cast("array<string>")
    fields = lambda c: F.map_from_arrays(keys, F.transform(keys, lambda k, i: known(F.try_element_at(F.split(c, ":"), (i + 1).cast("int")))))
    called = F.array(*(F.struct(F.lit(name).alias("name"), fields(part(9 + i)).alias("fields")) for i, name in enumerate(samples)))
    return lines.where(~left_out).select(checked.alias("f")).select(
        part(0).alias("chrom"), part(1).cast("bigint").alias("pos"), known(part(2)).alias("id"), part(3).alias("ref"), many(part(4), ",").alias("alts"), known(part(5)).try_cast("float").alias("qual"), many(part(6), ";").alias("filters"),
        last.alias("info"), keys.alias("format"), (called if samples else F.array().cast("array<struct<name:string,fields:map<string,string>>>")).alias("samples"),
    )


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """The samples of a file's #CHROM line."""
    found = spark.read.text(path).where(F.col("value").startswith("#CHROM")).take(1)
    if not found:
        raise ValueError(f"{path} has no #CHROM line")
    return found[0].value.rstrip("\r").split("\t")[9:]


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(spark.read.text(path), sample_names(spark, path))


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    return parse_header(spark.read.text(path))


def alleles() -> Column:
    """The reference and the alternatives: allele 0 is the reference."""
    return F.concat(F.array("ref"), "alts")


def info_value(key: str, kind: str) -> Column:
    """The first value of an info key as kind (a flag: whether it is there); null if missing or of another type."""
    if kind == "flag":
        return F.coalesce(F.map_contains_key("info", key), F.lit(False))
    value = F.col("info")[key]
    return value if kind == "string" else F.split(value, ",")[0].try_cast({"integral": "bigint", "floating": "double"}[kind])


def format_values(key: str, kind: str = "string") -> Column:
    """All values of a format key over the samples, in order; missing ones are null."""
    to = {"string": "string", "integral": "bigint", "floating": "double"}[kind]
    split = F.transform("samples", lambda s: F.transform(F.coalesce(F.split(s["fields"][key], ","), F.array(F.lit(None).cast("string"))), lambda v: F.nullif(v, F.lit(".")).try_cast(to)))
    return F.flatten(split)


def genotypes(field: Column) -> Column:
    """(allele, phased, missing) of each part of a genotype; a missing allele is -1; the first part is as phased as the second."""
    parts = F.regexp_extract_all(field, F.lit(r"[|/]?(?:\d+|\.)"), F.lit(0))
    one = lambda x: F.regexp_replace(x, "^[|/]", "")
    phased = lambda x, i: F.when(i == 0, F.coalesce(F.try_element_at(parts, F.lit(2)).startswith("|"), F.lit(False))).otherwise(x.startswith("|"))
    return F.transform(parts, lambda x, i: F.struct(F.coalesce(one(x).try_cast("int"), F.lit(-1)).alias("allele"), phased(x, i).alias("phased"), (one(x) == ".").alias("missing")))


def chosen_samples(names: list[str], wanted: str | None) -> list[str]:
    """The wanted sample, or all if there is none such."""
    return [wanted] if wanted in names else list(names)


def heterozygous(wanted: str | None = None) -> Column:
    """Whether the first two alleles of a genotype differ in the wanted sample, or in any if it is not there.

    A missing allele counts as one of its own.
    """
    selected = F.filter("samples", lambda s: s["name"] == wanted) if wanted is not None else F.col("samples")
    used = F.when(F.size(selected) > 0, selected).otherwise(F.col("samples"))
    g = lambda s: genotypes(s["fields"]["GT"])
    return F.exists(used, lambda s: F.coalesce((F.size(g(s)) >= 2) & (F.try_element_at(g(s), F.lit(1))["allele"] != F.try_element_at(g(s), F.lit(2))["allele"]), F.lit(False)))


def merge_vcfs(files: list[DataFrame]) -> DataFrame:
    """chrom, pos, records: the records of several files at each place."""
    out = None
    for i, df in enumerate(files):
        one = df.select("chrom", "pos", F.struct(F.lit(i).alias("file"), "ref", "alts", "qual").alias("record"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list("record")).alias("records"))
