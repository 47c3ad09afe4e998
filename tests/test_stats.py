import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import stats as fs
from strandloom.operators import matrix, stats, table


def test_gamma_tails_equal_closed_forms():
    x = np.array([0.0, 1e-6, 0.1, 0.5, 1, 2, 5, 10, 30, 100, 300])
    for n in (1, 2, 3, 7, 20):
        upper = np.array([sum(math.exp(-v + i * math.log(v) - math.lgamma(i + 1)) if v else float(i == 0) for i in range(n)) for v in x])
        np.testing.assert_allclose(fs.gamma_tails(n, x)[1], upper, rtol=1e-10)
    half = np.array([math.erfc(math.sqrt(v)) for v in x])
    np.testing.assert_allclose(fs.gamma_tails(0.5, x)[1], half, rtol=1e-10)  # far tails too
    np.testing.assert_allclose(fs.gamma_tails(0.5, x)[0], [math.erf(math.sqrt(v)) for v in x], rtol=1e-10)
    assert np.isnan(fs.gamma_tails(np.array([0.0, -1, np.nan, 1]), np.array([1, 1, 1, np.nan]))).all()


def test_columns(spark):
    df = spark.createDataFrame([(4.0, 2), (50.0, 1), (0.0, 3), (None, 1), (1.0, 0)], "x double, n int")
    got = [r[0] for r in df.select(fs.chi2_tail(F.col("x"), F.col("n"))).collect()]
    np.testing.assert_allclose(got[:3], [math.exp(-2), math.erfc(5), 1.0], rtol=1e-10)
    assert got[3:] == [None, None]
    assert spark.range(1).select(fs.gamma_tail(F.lit(-1.0), F.lit(2.0), F.lit(1.0)), fs.gamma_tail(F.lit(3.0), F.lit(1.0), F.lit(2.0))).first()[0] == 1.0
    g = spark.range(1).select(fs.g_statistic(F.lit(30), F.lit(10)), fs.g_statistic(F.lit(5), F.lit(0)), fs.g_statistic(F.lit(0), F.lit(0))).first()
    np.testing.assert_allclose(g, [2 * (30 * math.log(1.5) + 10 * math.log(0.5)), 10 * math.log(2), 0])


def test_genotype_fits(spark):
    df = spark.createDataFrame([([0.95, 0.05],), ([0.5, 0.5],), ([1.0],), ([0.6, 0.3, 0.1],)], "p array<double>")
    rows = df.withColumn("hom", fs.homozygous_fit(F.col("p"))).withColumn("het", fs.heterozygous_fit(F.col("p"))).select("hom", "het", *fs.genotype(F.col("hom"), F.col("het"))).collect()
    assert (rows[0][2], rows[1][2], rows[2][0], rows[2][1]) == ("hom", "het", 0.0, 1.0)
    chi = (0.6 - 0.95) ** 2 / 0.95 + sum((p - 0.05 / 3) ** 2 / (0.05 / 3) for p in (0.3, 0.1))
    assert abs(rows[3][0] - (1 - math.exp(-chi / 2))) < 1e-10


def test_gamma_fit(spark):
    x = np.random.default_rng(1).gamma(3.0, 0.5, 4000)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", -1.0), ("a", 0.0), ("b", 1.0)], "g string, x double")
    got = {r.g: r for r in stats.gamma_fit(df, "x", ["g"]).collect()}
    assert got["a"].gamma_n == 4000 and abs(got["a"].k - 3) < 0.25 and abs(got["a"].theta - 0.5) < 0.05
    assert got["b"].k is None and got["b"].theta is None


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.001), (2, 0.2), (3, 0.012), (4, 0.03)], "id long, p double")
    got = {r.id: r.threshold for r in stats.bh_threshold(df, "p", 0.05).collect()}
    assert got == pytest.approx({1: 0.0, 3: 0.0125, 4: 0.025, 2: 0.0375})
    assert {r.threshold for r in stats.bh_threshold(df, "p", 0.05, "standard").collect()} == {0.75 * 0.05}


def test_shares_and_divergence(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 2, 3, 0.5), ("b", 1, 0, 0.5)], "g string, k int, n int, q double")
    d = {r.g: r.kld for r in stats.kl_divergence(stats.shares(df, "n", ["g"]), "p", "q", ["g"]).collect()}
    assert d["a"] == pytest.approx(0.25 * math.log(0.5) + 0.75 * math.log(1.5)) and d["b"] == 0.0
    assert stats.median(df, "n", ["g"]).where("g = 'a'").first().median == 2.0


def test_tables(spark):
    df = spark.createDataFrame([("b", 1, "1,2", "3:x"), ("a", 2, "1,z", "3"), ("a", 3, "", "q:x")], "n string, v int, l string, p string")
    assert [r.v for r in table.order_by(df, ["n", "-v"]).collect()] == [3, 2, 1] == [r.v for r in table.order_by(df, [1, -2]).collect()]
    for keys in (["q"], [9], [0]):
        with pytest.raises(ValueError):
            table.order_by(df, keys)
    got = table.parse_columns(df, {"l": "list<int>", "p": "pair<int,string>"}).orderBy("v").collect()
    assert [r.l for r in got] == [[1, 2], None, []] and [r.p and tuple(r.p) for r in got] == [(3, "x"), None, None]
    assert [r[0] for r in df.orderBy("v").select(table.factor(F.col("n"), ["a", "b"])).collect()] == [1, 0, 0]
    with pytest.raises(Exception, match="unknown level"):
        df.select(table.factor(F.col("n"), ["a"])).collect()
    assert {tuple(r) for r in table.counted(df.withColumn("hit", F.col("v") > 1), "hit").select("hit", "n").collect()} == {(True, 2), (False, 1)}
    genes = spark.createDataFrame([("a", "x"), ("a", "y")], "other string, `Gene Symbol` string")
    assert {r.gene for r in table.genes_from(genes).collect()} == {"x", "y"} and {r.gene for r in table.genes_from(genes.select("other")).collect()} == {"a"}


def test_matrices(spark):
    r = np.random.default_rng(2)
    w, h = r.random((6, 2)), r.random((2, 5))
    v = w @ h
    frame = lambda m: spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(m)], "row long, col long, value double")

    def back(df, shape):
        out = np.zeros(shape)
        for x in df.collect():
            out[x.row, x.col] = x.value
        return out

    np.testing.assert_allclose(back(matrix.multiply(frame(w), frame(h)), (6, 5)), v)
    np.testing.assert_allclose(back(matrix.transpose(frame(w)), (2, 6)), w.T)
    a, b, changes = matrix.nmf(frame(v), 2, 3, seed=1)
    assert changes[-1] < changes[0] and np.abs(back(a, (6, 2)) @ back(b, (2, 5)) - v).mean() < 0.2


def test_nmf_is_that_of_numpy(spark):
    """Factors and changes of a sparse matrix with a full row, repeated cells, nulls and an empty column, against NumPy."""
    r = np.random.default_rng(3)
    rows = [(0, j, float(r.random())) for j in range(40)] + [(int(i), int(j), float(r.random())) for i, j in r.integers(0, 40, (150, 2))]
    rows += [(3, 5, None), (None, 1, 2.0), (1, None, 2.0), (2, 41, 0.0)]
    v = np.zeros((40, 42))
    for i, j, x in rows:
        if i is not None and j is not None:
            v[i, j] += x or 0.0
    seen = [sorted({x[k] for x in rows if None not in x[:2]}) for k in (0, 1)]
    ids = [{x: n for n, x in enumerate(of)} for of in seen]
    dense = v[np.ix_(*seen)]
    w, h = np.array([[1 / (1 + i + 2 * k) for k in range(3)] for i in seen[0]]), np.array([[1 / (1 + j + 3 * k) for j in seen[1]] for k in range(3)])
    want = []
    for _ in range(4):
        below = w.T @ w @ h
        new_h = h * (w.T @ dense) / (below + (below == 0))
        new_w = w * (dense @ new_h.T) / (w @ new_h @ new_h.T + (w @ new_h @ new_h.T == 0))
        want.append(((new_h - h) ** 2).sum() + ((new_w - w) ** 2).sum())
        w, h = new_w, new_h
    start = lambda f, row, col: 1 / (1 + row + 2 * col) if f == "w" else 1 / (1 + col + 3 * row)
    frame = spark.createDataFrame(rows, "row long, col long, value double").repartition(5)
    a, b, changes = matrix.nmf(frame, 3, 4, start=start)
    np.testing.assert_allclose(changes, want, rtol=1e-9)
    for df, of, at in ((a, w, lambda x: (ids[0][x.row], x.col)), (b, h, lambda x: (x.row, ids[1][x.col]))):
        got = np.full(of.shape, np.nan)
        for x in df.collect():
            got[at(x)] = x.value
        np.testing.assert_allclose(got, of, rtol=1e-9, atol=1e-15)
    none, _, moved = matrix.nmf(frame.where("false"), 2, 2)
    assert none.count() == 0 and moved == [0.0, 0.0]
    with pytest.raises(ValueError):
        matrix.nmf(frame, 0, 1)
