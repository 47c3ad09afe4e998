"""Near-duplicates, top-k and chat formatting against brute force, and their edge cases."""

import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat_format, near_dedup, topk_mtree
from strandloom.llm.components import connected_components


def word_set(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width, percent):
    sets = {i: word_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(seed, bases, copies, changes):
    r = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(40)]
    for b in range(bases):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 120))]
        for c in range(copies):
            words = list(base)
            for _ in range(r.randint(0, changes)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
            if c % 4 == 3:
                words = passage + words
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,bases,copies,changes", [(1, 12, 8, 4), (2, 2, 60, 5), (3, 30, 3, 2)])
def test_near_duplicates_equal_brute_force(spark, seed, bases, copies, changes):
    rows = near_texts(seed, bases, copies, changes)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=width).collect()}
        assert got == brute_components(rows, width, 80)


def joined(pairs):
    """Smallest reachable member of everything in pairs."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("pre", [0, 30])
def test_rest_finds_what_stars_miss(spark, monkeypatch, pre):
    """All linked components come back from prefix filtering alone, by true links, whatever the sizes of the cells.

    The first ``pre`` documents of every text's copies may hang together already.
    """
    rows = near_texts(4, 3, 25, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = {i: word_set(t, 4) for i, t in rows}
    links = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    known = joined((a, b) for a, b in links if b < pre)
    sets = near_dedup.full_sets(df, df.select("doc_id", F.lit(True).alias("leads")), 4)
    rest = spark.createDataFrame([(i, len(s[i]), known.get(i, i)) for i, _ in rows], "doc_id long, n long, component long")
    for block, least in ((2048, 256), (6, 3), (6, 1000), (1, 3)):  # one cell, blocks of groups, short lists alone, tiny blocks
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "LIST", least)
        monkeypatch.setattr(near_dedup, "PART", 4 if least == 3 else 256)
        got = {(r.a, r.b) for r in near_dedup.links_of_rest(rest, sets, 80).collect()}
        assert got <= links
        assert joined([*got, *known.items()]) == joined(links)


def test_a_group_gives_fewer_links_than_members(spark):
    """Unlinked near copies of one text: no pair of them is a row, linked ones give a forest."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if r.random() < 0.975 else f"x{r.randint(0, 10**6)}" for w in base)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.full_sets(df, df.select("doc_id", F.lit(True).alias("leads")), 4)
    rest = df.select("doc_id", F.lit(197).cast("long").alias("n"), F.col("doc_id").alias("component"))
    got = [(r.a, r.b) for r in near_dedup.links_of_rest(rest, sets, 80).collect()]
    assert 0 < len(got) <= 399
    want = {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}
    assert {i: joined(got).get(i, i) for i in want} == want


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, long), (8, long + " x"), (9, "a b c"), (9, "a b c")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows] + [(None, "one", 0, "x")], "doc_id long, text string, component_id int, key string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, width=4).collect())
    n = 29_997
    assert got == [(0, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, n, 7, True), (8, n + 1, 7, False), (9, 1, 6, False), (9, 1, 6, False)]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        items = r.integers(0, 1 << 63, n, dtype=np.uint64)
        assert not (near_dedup.sketch(items, 120) == np.iinfo(np.uint64).max).any()
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = np.mean([(near_dedup.sketch(a ^ np.uint64(s), 240) == near_dedup.sketch(b ^ np.uint64(s), 240)).mean() for s in range(10)])
    assert abs(same - 900 / 1100) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 5), (7, 8), (8, 7), (9, 3), *((i, i + 1) for i in range(20, 60)), (None, 4)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, **{i: 20 for i in range(20, 61)}}
    assert connected_components(edges.where("false")).count() == 0


def test_components_of_edges_that_differ_each_time(spark):
    def star(batches):  # another spanning tree of the same ids whenever it is computed
        for batch in batches:
            ids = batch.column(0).to_pylist()
            center = random.SystemRandom().choice(ids)
            yield pa.RecordBatch.from_pydict({"a": [center] * len(ids), "b": ids})

    edges = spark.range(50, numPartitions=1).mapInArrow(star, "a long, b long")
    for _ in range(3):
        assert [tuple(r) for r in connected_components(edges).orderBy("id").collect()] == [(i, 0) for i in range(50)]


def brute_top(rows, k, every):
    vectors = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = set()
    for i, q in vectors:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in vectors if j != i and len(v) == len(q))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed,n,dim,spread,tree_rows", [(1, 400, 8, 0.3, 32), (2, 600, 3, 0.0, 64), (3, 300, 16, 3.0, 16), (4, 9, 4, 1.0, 512)])
def test_top_k_equals_brute_force(spark, seed, n, dim, spread, tree_rows):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = [(i, [float(x) for x in centres[r.integers(6)] + spread * r.normal(size=dim)]) for i in range(n)]
    got = topk_mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, tree_rows=tree_rows)
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(x) for x in got.collect()} == brute_top(single, 10, 10)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0, 0.0]), (100, [0.0]), (101, [2.0]), (200, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    assert {tuple(x) for x in topk_mtree.top_k(df).collect()} == {(0, 1, 7, 1 << 20), (0, 2, 5, 1 << 19), (0, 3, 6, 1 << 19), (100, 1, 101, 0)}
    assert topk_mtree.top_k(df.where("false")).count() == 0


def test_triangle_bounds_save_distances():
    r = np.random.default_rng(3)
    v = np.concatenate([np.floor(1000 * (c + 0.05 * r.normal(size=(200, 6)))).astype(np.int64) for c in r.normal(size=(10, 6)) * 5])
    norms = (v * v).sum(1).astype(float)
    import pandas as pd

    pages = topk_mtree.build(np.arange(len(v)), v, np.sqrt(norms.max() - norms))
    tree = topk_mtree.Tree(pd.DataFrame(pages, columns=["page", "leaf", "refs", "vectors", "extra", "radius", "to_parent"]), 6, norms.max())
    found = tree.search(-1, v[0], 5, None)
    assert {s for s, _ in found} == set(np.sort(v @ v[0])[-5:].tolist()) and tree.seen < len(pages) / 2


def test_top_k_of_repeated_queries_and_large_products(spark):
    """Equal query rows have ranks of their own; products beyond the doubles are exact; blocks change nothing."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(np.clip(r.normal(size=5) * 20_000, -32_000, 32_000))]) for i in range(300)]
    rows += [rows[100], rows[100], (100, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in topk_mtree.top_k(df, tree_rows=40, block=2).collect())
    want = []
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for i, q in vectors:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i)[:10]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got == sorted(want) and len(got) == 60


CALLS = "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>"
SCHEMAS = {"add": {"required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "how": {"type": "string", "enum": ["fast", "slow"]}}, "additionalProperties": False}, "say": {"properties": {"text": {"type": "string", "minLength": 1}}}}


def test_link_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "add", '{"b": 2, "a": 1}', []), (1, "b", 1, "add", '{"a": 1.5, "b": 2}', ["a"]), (1, "c", 2, "say", '{"text": ""}', ["zz"]), (1, "d", 3, "none", "{}", None), (1, "e", 4, "say", None, []), (1, "f", 5, "say", "{oops", []), (1, "g", 6, "add", '{"a":1,"b":2,"x":3}', []), (1, "h", 7, "add", '{"a":1,"b":2.5,"how":"fast"}', []),
            (2, "late", 0, "say", '{"text":"x"}', ["early"]), (2, "early", 1, "say", '{"text":"é\\n\\"q\\""}', []), (2, "last", 2, "say", "{}", ["late", "early"]),
            (3, "x", 0, "say", "{}", ["y"]), (3, "y", 1, "say", "{}", ["x"]), (3, "z", 2, "say", "{}", []), (None, "n", 0, "say", "{}", []), (4, "r", 0, "say", "{}", []), (4, "r", 0, "say", "{}", []),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, "a", "3"), (1, "a", "4"), (2, "early", None), (9, "q", "lost")], "conv_id long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in chat_format.link_calls(calls, results, SCHEMAS).collect()}
    assert [k[1] for k in sorted(got, key=lambda k: (k[0], got[k].position)) if k[0] == 2] == ["early", "late", "last"]
    assert sorted(got[3, x].position for x in "xyz") == [0, 1, 2] and got[3, "z"].position == 0 and not got[3, "x"].valid and not got[3, "y"].valid
    assert {k[1]: r.valid for k, r in got.items() if k[0] == 1} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False, "g": False, "h": True}
    assert got[1, "a"].linked and not got[1, "b"].linked and got[2, "early"].linked
    assert got[1, "a"].json == '{"arguments":{"a":1,"b":2},"id":"a","name":"add","position":0,"result":"3"}'
    assert json.loads(got[2, "early"].json)["arguments"] == {"text": 'é\n"q"'} and json.loads(got[1, "f"].json)["arguments"] is None
    assert len(got) == 8 + 3 + 3 + 1
    assert chat_format.link_calls(calls.where("false"), results, SCHEMAS).count() == 0


VALUES = ['5', '12', '2.5', '-1', '"ab"', '"abcdef"', 'true', 'null', '[1, 2]', '[]', '["x"]', '[1, "x", 2.5]', '{"a": 1}', '{"a": "x"}', '{}', '{"b": [1]}', '"5"']
RULES = [
    {"type": "integer", "minimum": 10}, {"type": ["integer", "null"]}, {"type": "number", "maximum": 5}, {"exclusiveMinimum": 5}, {"exclusiveMaximum": 5}, {"type": "string", "maxLength": 2}, {"minLength": 3}, {"pattern": "^a"},
    {"type": "array", "items": {"type": "integer"}}, {"minItems": 1}, {"maxItems": 1}, {"items": {"type": ["number", "string"]}}, {"type": "object", "properties": {"a": {"type": "integer"}}}, {"required": ["a"]}, {"properties": {"b": {"items": {"minimum": 2}}}},
    {"enum": [5, "ab", None]}, {"const": [1, 2]}, {"type": "object", "additionalProperties": False}, {"properties": {"a": {}}, "additionalProperties": False}, {"type": "boolean", "description": "said"}, {}, {"properties": {"a": False}},
]


def obeys(x, rule):
    """What a schema means, by hand."""
    if isinstance(rule, bool):
        return rule
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = {"integer": number and isinstance(x, int), "number": number, "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "array": isinstance(x, list), "object": isinstance(x, dict)}
    names = rule.get("type", list(kinds))
    ok = any(kinds[k] for k in ([names] if isinstance(names, str) else names))
    same = lambda a, b: type(a) is type(b) and a == b
    ok &= "enum" not in rule or any(same(x, e) for e in rule["enum"])
    ok &= "const" not in rule or same(x, rule["const"])
    if number:
        ok &= rule.get("minimum", x) <= x <= rule.get("maximum", x) and x > rule.get("exclusiveMinimum", x - 1) and x < rule.get("exclusiveMaximum", x + 1)
    if isinstance(x, str):
        ok &= rule.get("minLength", 0) <= len(x) <= rule.get("maxLength", 99) and bool(re.search(rule.get("pattern", ""), x))
    if isinstance(x, list):
        ok &= rule.get("minItems", 0) <= len(x) <= rule.get("maxItems", 99) and all(obeys(i, rule.get("items", {})) for i in x)
    if isinstance(x, dict):
        own = rule.get("properties", {})
        ok &= all(k in x for k in rule.get("required", [])) and (rule.get("additionalProperties", True) or set(x) <= set(own)) and all(obeys(x[k], r) for k, r in own.items() if k in x)
    return ok


def test_schemas_equal_what_they_mean(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i long, v string").withColumn("x", F.parse_json("v"))
    got = df.select("i", *(chat_format.conforms(F.col("x"), rule).alias(f"r{n}") for n, rule in enumerate(RULES))).collect()
    for row in got:
        for n, rule in enumerate(RULES):
            assert row[f"r{n}"] == obeys(json.loads(VALUES[row.i]), rule), (VALUES[row.i], rule)


def test_schemas_that_cannot_be_checked_raise():
    for schema in ({"multipleOf": 2}, {"properties": {"a": {"oneOf": []}}}, {"properties": {"a'b\"c": {}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            chat_format.conforms(F.lit(None), schema)


def test_names_with_quotes(spark):
    calls = spark.createDataFrame([(1, "a", 0, "q", json.dumps({"it's": 1}), []), (1, "b", 1, "q", json.dumps({"it's": "x"}), [])], CALLS)
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = {r.call_id: r.valid for r in chat_format.link_calls(calls, results, {"q": {"properties": {"it's": {"type": "integer"}}}}).collect()}
    assert got == {"a": True, "b": False}


@pytest.mark.parametrize("group", [20_000, 0])
def test_orders_by_passes_and_by_rounds_agree(spark, monkeypatch, group):
    """A long chain against the order of its calls, a cycle, repeated dependencies; both ways to place them."""
    monkeypatch.setattr(chat_format, "GROUP", group)
    n = 200 if group else 6
    rows = [(1, f"c{i}", n - i, "say", "{}", [f"c{i - 1}"] * 2 if i else None) for i in range(n)]
    rows += [(2, "x", 0, "say", "{}", ["y"]), (2, "y", 1, "say", "{}", ["x"]), (2, "z", 2, "say", "{}", ["x"]), (2, "w", 3, "say", "{}", [])]
    calls = spark.createDataFrame([(*r, "s", 7) for r in rows], CALLS + ", json string, position int")
    results = spark.createDataFrame([(1, "c0", "r", 1)], "conv_id long, call_id string, content string, linked int")
    got = {(r.conv_id, r.call_id): r for r in chat_format.link_calls(calls, results, SCHEMAS).collect()}
    assert [got[1, f"c{i}"].position for i in range(n)] == list(range(n)) and got[1, "c0"].linked
    assert got[2, "w"].position == 0 and sorted(got[2, c].position for c in "xyz") == [1, 2, 3] and not got[2, "z"].valid and got[2, "w"].valid


def test_conversation_calls(spark):
    df = spark.createDataFrame([(1, 0, "system", "s", 1), (1, 1, "user", "q1", 1), (1, 2, "assistant", "a1", 1), (1, 3, "user", None, 1), (1, 4, "assistant", None, 1), (2, 0, "user", "x", 1), (2, 0, "user", "x", 1), (None, 0, "user", "x", 1), (3, 0, None, "x", 1)], "conv_id long, turn long, role string, text string, position int")
    got = sorted((r.conv_id, r.call_id, r.position, r.linked, r.valid) for r in chat_format.link_calls(*chat_format.conversation_calls(df), chat_format.ASK).collect())
    assert got == [(1, "t1", 0, True, True), (1, "t3", 1, True, False), (2, "t0", 0, False, True)]


def longest(calls, edges):
    """The level of every call by plain recursion over the order, and those in or behind a cycle."""
    level, after = {}, {c: [b for a, b in edges if a == c] for c in calls}
    while ready := [c for c in calls if c not in level and all(on in level for on in after[c])]:
        level |= {c: max((level[on] + 1 for on in after[c]), default=0) for c in ready}
    return {c: (level.get(c, 0), c not in level) for c in calls}


def test_levels_of_long_conversations(spark):
    """Chains in a random order, ladders, calls of many dependencies, cycles, and what hangs on them."""
    rng = np.random.default_rng(5)
    names = [f"n{i}" for i in rng.permutation(300)]
    edges = {(names[i], names[i - 1]) for i in range(1, 120)}  # a chain
    edges |= {(names[i], names[i - 1 - k]) for i in range(123, 129) for k in range(2)}  # a ladder behind a call of its own
    edges |= {(names[140], names[i]) for i in (0, 60, 119, 128)} | {(names[i], names[i - 1]) for i in range(141, 170)}
    edges |= {(names[171], names[170]), (names[170], names[171]), (names[172], names[171]), (names[173], names[172]), (names[174], names[174])}
    edges |= {(names[175], names[173]), (names[175], names[0]), (names[176], names[175])}  # behind a cycle
    edges |= {(names[i], names[int(j)]) for i in range(200, 240) for j in rng.integers(180, i, 2)}
    want = {(conv, c): v for conv in (1, 2) for c, v in longest(names, edges).items()}
    calls = spark.createDataFrame([(conv, c) for conv in (1, 2) for c in names], "conv_id long, call_id string")
    links = spark.createDataFrame([(conv, *e) for conv in (1, 2) for e in sorted(edges)], "conv_id long, call_id string, on string")
    got = chat_format.long_levels(calls, links).collect()
    assert len(got) == len(want) and {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in got} == want
    none = chat_format.long_levels(calls, links.where("false")).collect()
    assert {(r.level, r.cyclic) for r in none} == {(0, False)} and len(none) == len(want)
