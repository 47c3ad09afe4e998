"""Matrices as (row, col, value) rows: transpose, product, non-negative factorisation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strandloom.sources.shared import cut, discard

#: The largest rank of a factorisation: the driver gets matrices of rank x rank numbers.
MAX_RANK = 128


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product as a join on the inner index and a sum; cells that are not there count as 0."""
    left, right = a.select("row", F.col("col").alias("inner"), F.col("value").alias("x")), b.select(F.col("row").alias("inner"), "col", F.col("value").alias("y"))
    return left.join(right, "inner").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))


def _gram(factor: DataFrame, rank: int) -> np.ndarray:
    """The rank x rank products of a factor's vectors: one matrix a task, summed by cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            v = _vectors(batch.column(0), rank)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank * rank)), pa.array(total.reshape(-1))], names=["cell", "x"])

    cells = factor.select("v").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()  # rank * rank rows
    out = np.zeros(rank * rank)
    for c in cells:
        out[c.cell] = c.x
    return out.reshape(rank, rank)


def _updated(factor: DataFrame, other: DataFrame, cells: DataFrame, own: str, across: str, rank: int) -> DataFrame:
    """A factor after one multiplicative update by the other, with the squared change of each vector.

    One pass over the cells: they meet the other factor's vectors, and sums of rank columns are combined in each task
    before they go to the own index. The denominator is the small product of the other factor with itself.
    """
    gram = _gram(other, rank)
    met = cells.join(other.withColumnsRenamed({"id": across, "v": "_v"}), across)
    sums = met.groupBy(own).agg(*(F.sum(F.col("value") * F.col("_v")[i]).alias(f"_{i}") for i in range(rank)))
    up = sums.select(F.col(own).alias("id"), F.array(*(F.coalesce(f"_{i}", F.lit(0.0)) for i in range(rank))).alias("up"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, above = _vectors(batch.column(1), rank), _vectors(batch.column(2), rank)
            below = v @ gram
            new = v * np.divide(above, below, out=np.zeros_like(v), where=below != 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(new), pa.array(((new - v) ** 2).sum(1))], names=["id", "v", "moved"])

    schema = StructType([factor.schema["id"], StructField("v", ArrayType(DoubleType())), StructField("moved", DoubleType())])
    return factor.join(up, "id").select("id", "v", "up").mapInArrow(run, schema)


def hashed_start(seed: int) -> Callable[[str, Column, Column], Column]:
    """Numbers above 0 and at most 1, by a hash of the seed, the factor and both indices."""
    return lambda factor, row, col: (F.pmod(F.xxhash64(F.lit(seed), F.lit(1 if factor == "w" else 2), row, col), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20))


def nmf(v: DataFrame, rank: int, iterations: int, seed: int = 0, start: Callable[[str, Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """w, h as (row, col, value) and the squared change of each iteration, by multiplicative updates: v is about w h.

    A factor is a table of one vector an index. An update shuffles the cells of v at most once, beside sums that are
    combined beforehand, so an iteration, which has two, at most twice; vectors are a row an index. Each factor is
    written to the shared folder, and those of the iteration before are deleted.

    start: (factor, row, col) -> the first value, by default ``hashed_start``: the same seed gives the same factors.
    Cells that are not there, and null values, count as 0; cells that are repeated are summed; rows with a null index
    are left out. Where a denominator is 0, so is the value. No cells: empty factors. rank is 1 to ``MAX_RANK``.
    """
    if not 1 <= rank <= MAX_RANK:
        raise ValueError(f"rank is 1 to {MAX_RANK}")
    first = start or hashed_start(seed)
    known = v.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    cells = cut(known.groupBy("row", "col").agg(F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("value")), "cells")
    index = [F.lit(i).cast("long") for i in range(rank)]
    made = {
        "w": F.array(*(first("w", F.col("row"), i).cast("double") for i in index)),
        "h": F.array(*(first("h", i, F.col("col")).cast("double") for i in index)),
    }
    side = {"w": ("row", "col"), "h": ("col", "row")}
    now = {f: cut(cells.select(own).distinct().select(F.col(own).alias("id"), made[f].alias("v")), f) for f, (own, _) in side.items()}
    changes = []
    for _ in range(iterations):
        moved = 0.0
        for f, other in (("h", "w"), ("w", "h")):
            new = cut(_updated(now[f], now[other], cells, *side[f], rank), f)
            moved += new.agg(F.sum("moved")).first()[0] or 0.0
            discard(now[f])
            now[f] = new
        changes.append(float(moved))
    discard(cells)
    w, h = (now[f].select(F.col("id").alias(side[f][0]), F.posexplode("v").alias("at", "value")).withColumn("at", F.col("at").cast("long")) for f in ("w", "h"))
    return w.withColumnRenamed("at", "col").select("row", "col", "value"), h.withColumnRenamed("at", "row").select("row", "col", "value"), changes
