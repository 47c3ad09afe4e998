"""Scans over ranges of an order: equal to plain loops in any number of ranges, and no range holds more than its share."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals, kmers, ordered, stats, table


@pytest.fixture(params=[1, 7, 30])
def parts(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def keyed(seed, n):
    """Nearly all rows have one key; one is null and some have a single row."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 12 + ["b", None, f"k{i}"]), r.randint(-40, 900)) for i in range(n)]


def plain_runs(rows, width):
    out = []
    for key, pos in sorted(set(rows), key=lambda x: (x[0] or "", x[1])):
        if out and out[-1][0] == key and out[-1][2] + 1 == pos:
            out[-1][2] = pos
        else:
            out.append([key, pos, pos])
    return sorted(((k or "", lo, hi + width - 1) for k, lo, hi in out))


def test_runs_and_ranks_in_any_ranges(spark, parts):
    rows = keyed(1, 700)
    df = spark.createDataFrame(rows, "chrom string, pos long")
    got = intervals.coalesce_runs(df, by=["chrom"], width=3).collect()
    assert sorted((r.chrom or "", r.lo, r.hi) for r in got) == plain_runs(rows, 3)
    want = []
    for key in {k for k, _ in rows}:
        gaps, last = 0, None
        for rank, c in enumerate(sorted({c for k, c in rows if k == key})):
            gaps, last = gaps + (last is None or last + 1 < c), c
            want.append((key or "", c, rank, rank + gaps))
    got = intervals.dense_ranks(df, "pos", on="chrom").collect()
    assert sorted((r.chrom or "", r.coordinate, r["rank"], r.gapped) for r in got) == sorted(want)


def test_merge_in_any_ranges(spark, parts):
    r = random.Random(2)
    rows = [(k, p, p + r.choice([0, 1, 2, 5, 400 if i % 50 == 0 else 3])) for i, (k, p) in enumerate(keyed(2, 500))] + [("hot", None, 3), ("hot", 3, None)]
    want = []
    for key in {k for k, _, _ in rows}:
        runs = []
        for s, e in sorted({(s, e) for k, s, e in rows if k == key and s is not None and e is not None}):
            if runs and s <= runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], e)
            else:
                runs.append([key or "", s, e])
        want += map(tuple, runs)
    df = spark.createDataFrame(rows, "chrom string, start long, stop long")
    assert sorted((r.chrom or "", r.start, r.stop) for r in intervals.merge_regions(df).collect()) == sorted(want)


def test_ranks_and_thresholds_in_any_ranges(spark, parts):
    r = random.Random(3)
    rows = [(i, r.choice([None, 0.25, 0.25, 0.001 * r.randint(0, 9), r.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, p double")
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    place = {i: n for n, (i, _) in enumerate(order)}
    got = {x.id: x.threshold for x in stats.bh_threshold(df, "p", 0.1, tie="id").collect()}
    assert got == pytest.approx({i: n / 400 * 0.1 for i, n in place.items()})
    passing = max([(place[i] + 1) / 400 * 0.1 for i, p in rows if p is not None and p <= (place[i] + 1) / 400 * 0.1], default=None)
    assert {round(x.threshold, 12) for x in stats.bh_threshold(df, "p", 0.1, "standard", "id").collect()} == {round(passing, 12)}
    untied = sorted((x.p is not None, x.p or 0, x.threshold) for x in stats.bh_threshold(df, "p", 0.1).collect())
    assert [t for _, _, t in untied] == pytest.approx([n / 400 * 0.1 for n in range(400)])
    assert {x.id: x["rank"] for x in table.ranked(df, ["-p"], ["id"]).collect()} == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])))}
    members = spark.createDataFrame([(v,) for v in [*range(300), 10**15, None, 5]], "kmer long")
    assert sorted((x.kmer, x["rank"]) for x in kmers.ranked(members).collect()) == [(v, v) for v in range(300)] + [(10**15, 300)]
    assert kmers.ranked(members.limit(0)).count() == 0 and stats.bh_threshold(df.limit(0), "p", 0.1).count() == 0
    with pytest.raises(ValueError):
        stats.bh_threshold(df, "p", 0.1, "other")


def test_no_range_holds_more_than_its_share(spark):
    """All but a hundredth of the values lie in one narrow range, and all but a few rows have one key."""
    values = spark.range(100_000).select(F.when(F.col("id") % 100 == 0, F.col("id") * 10**12).otherwise(F.col("id")).alias("v"), F.when(F.col("id") < 99_900, F.lit("hot")).otherwise(F.lit("b")).alias("k"))
    for order in (["v"], ["k", "v"]):
        sizes = [r["count"] for r in ordered.ranged(values, *order, parts=16).groupBy(ordered.PART).count().collect()]
        assert len(sizes) == 16 and max(sizes) <= 2 * 100_000 / 16
