"""Every query of the library against its SQL, and the driver contract."""

import importlib
import math
import os
import pathlib
import re
import shutil
import subprocess
import sys
import zipfile

import duckdb
import pytest

import __spark_entry__
from strandloom import queries as library
from strandloom.operators import table


@pytest.fixture(scope="module")
def sql(tiny):
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_equals_sql(spark, tiny, sql, name):
    want = sql.execute(library.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = [tuple(map(plain, r)) for r in want.fetchall()]
    df = library.queries()[name](spark, tiny)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(float(v) if isinstance(g, float) and v is not None else v for v, g in zip(r, got[0], strict=True))) for r in rows) or sorted(got) == sorted(rows)


@pytest.mark.parametrize("name", ["kmer_scores", "divergence_models", "divergence_table"])
def test_whole_plans_have_rows(spark, tiny, name):
    assert library.queries()[name](spark, tiny).count() > 0


def test_whole_texts_give_every_letter_to_a_read(spark, tiny, sql):
    letters = [len(re.sub("[^a-z]+", "", text.lower())) for (text,) in sql.execute("SELECT text FROM documents").fetchall()]
    want = 2 * sum(max(0, min(50, n - at) - 2) for n in letters for at in range(0, n, 50))
    assert library.queries()["kmer_cycle_counts"](spark, tiny).agg({"n": "sum"}).first()[0] == want
    assert library.queries()["kmer_scores"](spark, tiny).count() > 0


def test_genotypes_of_any_number_of_alleles(spark, tiny, sql, tmp_path):
    sql.execute(f"COPY (SELECT * FROM lineitem WHERE l_orderkey < 60) TO '{tmp_path}/lineitem.parquet'")
    sql.execute(f"COPY (SELECT * FROM orders) TO '{tmp_path}/orders.parquet'")
    rows = sql.execute(f"SELECT l_suppkey, o_orderpriority, count(*) AS n FROM '{tmp_path}/lineitem.parquet' JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey, o_orderpriority, l_returnflag").fetchall()
    counts = {}
    for pos, sample, n in rows:
        counts.setdefault((pos, sample), []).append(n)
    cdf = {2: lambda x: math.erf(math.sqrt(x / 2)), 3: lambda x: 1 - math.exp(-x / 2)}
    want = {}
    for place, of_place in counts.items():
        n, shares = len(of_place), sorted((c / sum(of_place) for c in of_place), reverse=True)
        fit = lambda top: cdf[n](sum((p - e) ** 2 / e for p, e in zip(shares, top + [0.05 / n] * n)))  # noqa: B023, E731
        hom, het = (fit([0.95]), fit([0.475, 0.475])) if n > 1 else (0.0, 1.0)
        want[place] = (round(hom, 5), round(het, 5), "het" if het < hom else "hom")
    assert {len(x) for x in counts.values()} == {1, 2, 3}
    got = {(r.pos, r["sample"]): (r.hom, r.het, r.gt) for r in library.queries()["genotype_fit"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][:2] == pytest.approx(want[x][:2], abs=2e-5) and got[x][2] == want[x][2] for x in want)


def test_ranks_of_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None), (4, "a")], "id int, k string")
    assert [(r.rank, r.id) for r in table.ranked(df, ["k"], ["id"]).orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 4), (4, 2)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["kmer", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "strandloom.llm"])
def test_entry_without_the_subpackage(monkeypatch, tmp_path, gone):
    """A copy of the library without what may be missing is imported and offers all other queries."""
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__") if gone == "strandloom.llm" else None)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name != f"{gone}.py" and (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == sorted(library.queries()), said.stderr


def test_entry_hides_no_missing_library(monkeypatch):
    if not __spark_entry__.llm_queries:
        pytest.skip("the subpackage is not there")
    for name in [m for m in sys.modules if m.startswith("strandloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    try:
        with pytest.raises(ImportError):
            importlib.reload(__spark_entry__)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_archive_holds_the_library():
    with zipfile.ZipFile(__spark_entry__.archive()) as held:
        assert {"strandloom/__init__.py", "strandloom/operators/kmers.py"} <= set(held.namelist())


def test_genotypes_are_parsed_once_and_after_rows_are_dealt_out(spark, tiny):
    """No filter that Spark infers parses the lines too, in the one task of a small table."""
    plan = library.queries()["vcf_genotypes"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and not [x for x in plan.splitlines() if "Filter" in x and "map_from_arrays" in x]


@pytest.mark.parametrize("name", ["sam_pileup", "sam_depth", "pileup_indels"])
def test_sam_lines_are_split_once_and_after_rows_are_dealt_out(spark, tiny, name):
    """No filter of parsed fields splits the lines too, in the one task of a small table."""
    plan = library.queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and not [x for x in plan.splitlines() if "Filter" in x and ("split(" in x or "concat_ws" in x)]
