import random

import pytest

from strandloom.operators import intervals


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("width", [1, 16, 4096])
def test_stab_equals_scan(spark, width):
    r = random.Random(19)
    ivl = [(r.choice("xy"), lo := r.randint(-50, 100), lo + abs(int(r.gauss(0, 10))), i) for i in range(60)] + [("x", -10_000_000, 10_000_000, 60), ("x", 5, 4, 61), ("x", None, 4, 62), (None, 1, 2, 63), ("y", 3, 3, 64), ("y", 3, 3, 65)]
    pts = [(c, p) for c in "xyz" for p in range(-60, 130)] + [("x", None), (None, 1), ("x", 7), ("x", 7)]
    points, rows = frame(spark, pts, "chrom string, pos long"), frame(spark, ivl, "chrom string, lo long, hi long, i long")
    got = sorted((x.chrom, x.pos, x.i) for x in intervals.stab_join(points, rows, bin_width=width).collect())
    want = sorted((c, p, i) for c, p in pts for d, lo, hi, i in ivl if None not in (c, p, lo) and c == d and lo <= p <= hi)
    assert got == want
    semi = sorted((x.chrom, x.pos) for x in intervals.stab_join(points, rows, bin_width=width, how="left_semi").collect())
    assert semi == sorted((c, p) for c, p in pts if any((c, p) == (d, q) for d, q, _ in want))


def test_stab_before_all_and_of_nothing(spark):
    points, rows = frame(spark, [("1", 13418)], "chrom string, pos long"), frame(spark, [("1", 65419 + i, 1000172) for i in range(9)], "chrom string, lo long, hi long")
    assert intervals.stab_join(points, rows).count() == 0 and intervals.stab_join(points, rows.where("false")).count() == 0


def test_merge_and_membership(spark):
    r = random.Random(3)
    regions = [(r.choice("ab"), s := r.randint(0, 300), s + r.randint(1, 12)) for _ in range(60)]
    df = frame(spark, regions + regions[:5], "chrom string, start long, stop long")
    want = set()
    for c in "ab":
        runs = []
        for s, e in sorted((s, e) for d, s, e in regions if d == c):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        want |= {(c, s, e) for s, e in runs}
    merged = intervals.merge_regions(df)
    assert {tuple(x) for x in merged.collect()} == want
    points = frame(spark, [(c, p) for c in "abc" for p in range(320)], "chrom string, pos long")
    got = {tuple(x) for x in intervals.in_regions(points, merged, bin_width=8).collect()}
    assert got == {(c, p) for c in "ab" for p in range(320) if any(d == c and s <= p < e for d, s, e in want)}


def test_runs(spark):
    df = frame(spark, [("b", "1", p) for p in (0, 1, 2, 5, 7, 8, 8)] + [("c", "1", 1)], "bait string, chrom string, pos long")
    runs = intervals.coalesce_runs(df, by=["bait", "chrom"], width=3)
    assert {tuple(x) for x in runs.collect()} == {("b", "1", 0, 4), ("b", "1", 5, 7), ("b", "1", 7, 10), ("c", "1", 1, 3)}
    assert {(x.start, x.stop) for x in intervals.half_open(runs).collect()} == {(0, 5), (5, 8), (7, 11), (1, 4)}


def test_dense_ranks_have_cells_for_gaps(spark):
    df = frame(spark, [(10, 12), (13, 20), (12, 13)], "lo long, hi long")
    ranks = intervals.dense_ranks(df, "lo", "hi")
    assert {(x.coordinate, x.rank, x.gapped) for x in ranks.collect()} == {(10, 0, 1), (12, 1, 3), (13, 2, 4), (20, 3, 6)}
    points = frame(spark, [(p,) for p in (1, 10, 11, 12, 13, 15, 20, 99)], "pos long")
    assert {tuple(x) for x in intervals.sparse_to_dense(points, ranks).collect()} == {(1, 0), (10, 1), (11, 2), (12, 3), (13, 4), (15, 5), (20, 6), (99, 7)}


def test_having(spark):
    hits = frame(spark, [("g", 1), ("g", 1), ("h", 2)], "gene string, pos long")
    assert [tuple(x) for x in intervals.having_min_hits(hits, ["gene"], 2).collect()] == [("g", 2)]
