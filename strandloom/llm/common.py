"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.shared import clean, cut, discard, shared_folder

__all__ = ["clean", "cut", "discard", "id_and_text", "map_rows", "shared_folder", "small_batches", "table"]

#: Rows of one Arrow batch. Texts can be long, so a batch is kept far below Spark's default of 10,000.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: fewer rows to a batch, as texts may be long.

    The setting stays with the session, as results are made later than operators are called; a smaller one is kept.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, so that no other column can clash; a null text is an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def map_rows(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow over kernel, which returns a column list for every field of schema."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    }
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = kernel(batch)
            columns = (v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip((out[n] for n in names), kinds, strict=True))
            yield pa.RecordBatch.from_arrays(list(columns), names=names)

    return df.mapInArrow(run, schema)
