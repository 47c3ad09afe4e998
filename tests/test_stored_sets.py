"""Stored k-mer sets: runs are added and merged, and joins of them have no shuffle."""

import contextlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators.stored_sets import StoredSet


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def files(path):
    return list(path.glob("a/set-*/*.parquet"))


def test_runs_are_added_and_merged(spark, tmp_path):
    rng = random.Random(6)
    kept = StoredSet(spark, f"file://{tmp_path}/a", 5)
    assert kept.read().count() == 0 and kept.generation() is None
    want = Counter()
    for size in (300, 50, 1):
        rows = [(rng.randrange(200), rng.randrange(9)) for _ in range(size)]
        for k, n in rows:
            want[k] += n
        kept.add(spark.createDataFrame([*rows, (None, 3), (7, None)], "kmer long, n long"))
        want[7] += 0
        assert {tuple(r) for r in kept.read().collect()} == set(want.items())
    assert len(files(tmp_path)) > 5 and "Exchange" not in plan(kept.read())
    kept.add(spark.createDataFrame([(1,), (1,), (-5,)], "kmer long"))
    want[1] += 2
    want[-5] += 1
    kept.merge()
    assert len(files(tmp_path)) <= 5 and {tuple(r) for r in kept.read().collect()} == set(want.items())
    again = StoredSet(spark, f"file://{tmp_path}/a", 5)
    spark.sql(f"DROP TABLE {again._name(again.generation())}")  # as another session, whose catalog has no such table
    assert {tuple(r) for r in again.read().collect()} == set(want.items()) and "Exchange" not in plan(again.read())
    again.add(spark.createDataFrame([(1,)], "kmer long"))
    assert {r.kmer: r.n for r in again.read().collect()} == want | {1: want[1] + 1}


def test_joins_of_sets_have_no_shuffle(spark, tmp_path):
    a, b = (StoredSet(spark, f"file://{tmp_path}/{name}", 8) for name in "ab")
    a.add(spark.range(1_000).select((F.col("id") * 3).alias("kmer")))
    b.add(spark.range(1_000).select((F.col("id") * 5).alias("kmer")))
    b.add(spark.range(1_000).select((F.col("id") * 5).alias("kmer")))
    one, two = a.read(), b.read().withColumnRenamed("n", "m")
    for how, rows in (("inner", 200), ("left_semi", 200), ("left_anti", 800), ("full_outer", 1_800)):
        joined = one.join(two.hint("merge"), "kmer", how)
        assert "Exchange" not in plan(joined) and joined.count() == rows


def test_a_failed_run_is_not_there(spark, tmp_path):
    kept = StoredSet(spark, f"file://{tmp_path}/a", 3)
    kept.add(spark.range(10).withColumnRenamed("id", "kmer"))
    with pytest.raises(Exception, match="broken"):
        kept.add(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("kmer")))
    assert kept.read().count() == 10 and kept.read().agg(F.sum("n")).first()[0] == 10
