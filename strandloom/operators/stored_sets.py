"""K-mer sets with counts that are kept as tables, so that joins and unions of stored sets need no shuffle.

A set is a table bucketed and sorted by k-mer. Adding appends a run, one file a bucket that has any of it, and leaves the
files there alone; reading sums a bucket's files within one task. Sets with the same number of buckets agree on which
bucket holds a k-mer. Merging writes one file a bucket in a folder of the next generation; the last one that Spark has
committed counts. A job that failed leaves a set as it was.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StoredSet:
    """A set of k-mers (kmer long) with counts (n long) in a folder that all executors reach.

    One writer at a time; ``merge`` deletes what it has put together, so results that still read it must be written before.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def add(self, rows: DataFrame) -> None:
        """Add k-mers as a new run; counts of repeated ones are summed, null k-mers are left out, a null count is 0, and no count is 1 each."""
        n = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
        some = rows.where(F.col("kmer").isNotNull()).select(F.col("kmer").cast("long").alias("kmer"), F.coalesce(n, F.lit(0)).alias("n"))
        counts = some.groupBy("kmer").agg(F.sum("n").alias("n"))  # combined in each task, then dealt out by bucket
        self._write(counts, self.generation() or self._next(None))

    def generation(self) -> str | None:
        """The folder that counts, none before anything was added."""
        files, root = self._files()
        if not files.exists(root):
            return None
        names = (f.getPath().getName() for f in files.listStatus(root))
        done = [n for n in names if re.match(r"set-\d{6}-", n) and files.exists(self._place(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=None)

    def read(self) -> DataFrame:
        """kmer, n over all runs, without a shuffle; of no runs, no rows."""
        now = self.generation()
        if now is None:
            return self.spark.createDataFrame([], "kmer long, n long")
        return self._table(now).groupBy("kmer").agg(F.sum("n").alias("n"))

    def merge(self) -> None:
        """Put all runs together into one, and delete them when it is committed."""
        before = self.generation()
        if before is not None:
            self._write(self.read(), self._next(before))
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(before)}")
            self._files()[0].delete(self._place(f"{self.path}/{before}"), True)

    def _next(self, before: str | None) -> str:
        return f"set-{int(before.split('-')[1]) + 1 if before else 0:06d}-{uuid.uuid4().hex}"

    def _write(self, counts: DataFrame, folder: str) -> None:
        if folder == self.generation():
            self._table(folder)
        writer = counts.repartition(self.buckets, "kmer").write.format("parquet").mode("append").bucketBy(self.buckets, "kmer").sortBy("kmer")
        writer.option("path", f"{self.path}/{folder}").saveAsTable(self._name(folder))

    def _table(self, folder: str) -> DataFrame:
        """A folder as a bucketed table, named in this session's catalog if it is not there yet, with the files it has now."""
        name = self._name(folder)
        if not self.spark.catalog.tableExists(name):
            place = f"{self.path}/{folder}".replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {name} (kmer BIGINT, n BIGINT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _name(self, folder: str) -> str:
        return "kmers_" + hashlib.md5(f"{self.path}/{folder}".encode()).hexdigest()

    def _place(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        root = self._place(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root
