"""Tables in the folder that the driver and all executors share: they cut lineage, and lost executors lose nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where none is named, a local session gets a temporary one; on a cluster that is an error, as every executor
    would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back; ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing reads them any more."""
    for table in tables:
        _remove(table.sparkSession, table.cut_path)


def clean(spark: SparkSession) -> None:
    """Delete all that operators have left in the shared folder; results not yet written elsewhere go as well."""
    _remove(spark, f"{shared_folder(spark)}/strandloom")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
