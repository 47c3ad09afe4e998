"""Typed tables: sorting by names, parsing text columns, categories, profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.strings import trimmed
from strandloom.operators.ordered import numbered


def _order(df: DataFrame, keys: list[str | int]) -> tuple[list[str], list[Column]]:
    """The names of the keys, and the order by them."""
    names, order = [], []
    for key in keys:
        down = key < 0 if isinstance(key, int) else key.startswith("-")
        if isinstance(key, int):
            if not 1 <= abs(key) <= len(df.columns):
                raise ValueError(f"no column {key}")
            name = df.columns[abs(key) - 1]
        else:
            name = key.removeprefix("-")
            if name not in df.columns:
                raise ValueError(f"no column {name}")
        names.append(name)
        order.append(F.col(name).desc() if down else F.col(name).asc())
    return names, order


def order_by(df: DataFrame, keys: list[str | int], tie: list[str] = ()) -> DataFrame:
    """Sort by names (a leading - descends) or by 1-based ordinals (negative descends); an unknown key raises."""
    return df.orderBy(*_order(df, keys)[1], *tie)


def ranked(df: DataFrame, keys: list[str | int], tie: list[str]) -> DataFrame:
    """All rows with rank, their place (from 1) in the order of order_by; no task numbers more than its range of that order."""
    names, order = _order(df, keys)
    return numbered(df, *order, *(F.col(c) for c in tie if c not in names)).select("rank", *df.columns)


def parse_text(text: Column, kind: str) -> Column:
    """A text as string, int, float, list<kind>, pair<kind,kind> or tuple<kind,...>; null where it is none.

    The separators are a comma within lists and a colon within pairs and tuples.
    """
    simple = {"string": "string", "int": "bigint", "float": "double"}
    if kind in simple:
        return text if kind == "string" else trimmed(text).try_cast(simple[kind])
    m = re.fullmatch(r"(list|pair|tuple)<(.*)>", kind)
    if not m:
        raise ValueError(f"kind {kind}")
    if m[1] == "list":
        parts = F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",")), lambda x: parse_text(x, m[2]))
        return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)
    kinds = m[2].split(",")
    parts = F.split(text, ":")
    values = [parse_text(F.try_element_at(parts, F.lit(i + 1)), k) for i, k in enumerate(kinds)]
    whole = F.size(parts) == len(kinds)
    for v in values:
        whole &= v.isNotNull()
    return F.when(whole, F.struct(*(v.alias(f"_{i + 1}") for i, v in enumerate(values))))


def parse_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the named text columns parsed."""
    return df.withColumns({name: parse_text(F.col(name), kind) for name, kind in kinds.items()})


def factor(label: Column, levels: list[str]) -> Column:
    """0-based index of a label in a fixed list of levels; an unknown label raises an error when rows are read."""
    at = F.array_position(F.array(*map(F.lit, levels)), label) - 1
    return F.when(label.isNull(), None).when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown level "), label)).cast("bigint"))


def genes_from(df: DataFrame) -> DataFrame:
    """gene: the distinct names of a gene list, from the column Gene Symbol, else gene, else the first."""
    name = next((c for c in ("Gene Symbol", "gene") if c in df.columns), df.columns[0])
    return df.select(F.col(f"`{name}`").alias("gene")).distinct()


def include_exclude(df: DataFrame, column: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose value is on the include list, if there is one, and not on the exclude list (columns gene)."""
    if include is not None:
        df = df.join(include.select(F.col("gene").alias(column)), column, "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(F.col("gene").alias(column)), column, "left_anti")
    return df


def counted(df: DataFrame, flag: str) -> DataFrame:
    """flag, n, percent of all rows for each value of a flag."""
    n = df.groupBy(flag).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over one row for each value of the flag
    return n.withColumn("percent", F.col("n") * 100.0 / total)


def digest(text: Column, seed: int = 0) -> Column:
    """A 32-bit murmur3 digest of a text as Spark's hash has it."""
    return F.hash(F.lit(seed), text)

