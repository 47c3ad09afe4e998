"""Held-out accuracy of the trained operators, the pipeline, and edge cases."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import language_id, quality_rules
from strandloom.llm.common import cut
from tests.llm.test_links import brute_components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_held_out(docs):
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [i for i in got if got[i].held_out]
    assert set(out) == {i for i in truth if held(i)}
    assert np.mean([got[i].lang_pred == truth[i] for i in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.9  # sparse


def test_language_edges(spark, docs):
    model = language_id.fit(docs)
    edges = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 ?!", 1), (4, "und der die das nicht eine", 1), (None, "the of and", 1), (5, "the of and " * 50_000, 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in language_id.identify(edges, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred == "de" and got[5].lang_pred == "en" and not got[None].held_out
    empty = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(edges, empty).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0


def test_quality_held_out(docs, labels):
    model = quality_rules.fit(docs, labels)
    assert 0 < len(model.rules) < 80
    got = {r.doc_id: r for r in quality_rules.classify(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [i for i in truth if held(i)]
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.93
    assert all(r.held_out == held(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())


def test_quality_ignores_held_out_labels(docs, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_rules.fit(docs, labels) == quality_rules.fit(docs, flipped)


def test_quality_edges(spark, docs, labels):
    edges = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", "x"), (3, "word " * 50_000, "x"), (3, "word " * 50_000, "x")], "doc_id long, text string, score string")
    model = quality_rules.fit(docs, labels)
    got = quality_rules.classify(edges, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {next(r.score for r in got if r.doc_id == 1)}
    none = quality_rules.fit(docs, labels.where("false"))
    assert {r.score for r in quality_rules.classify(edges, none).collect()} == {0.5}
    one = quality_rules.fit(docs, labels.where("quality = 1"))
    assert min(r.score for r in quality_rules.classify(edges, one).collect()) > 0.9
    assert quality_rules.classify(docs.where("false"), model).count() == 0


def test_column_expression_equals_rules(spark, docs, labels):
    model = quality_rules.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.classify(docs, model).collect():
        x = dict(zip(quality_rules.STATISTICS, quality_rules.statistics(text[r.doc_id]), strict=True))
        z = model.bias + sum(rule.weight for rule in model.rules if all((x[n] > at) == above for n, above, at in rule.parts))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_pipeline(spark, tiny):
    docs, columns = spark.read.parquet(f"{tiny}/documents.parquet"), None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "exact dedup", "MinHash near-dedup", "best-fit packing"]
    kept = {r.doc_id for r in docs.collect()}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, tiny)
        columns = step.columns
        now = {r.doc_id for r in step.select("doc_id").collect()}
        assert now <= kept and columns == docs.columns
        kept = now
    texts = [r.text for r in step.collect()]
    assert len(texts) == len(set(texts)) == len(kept)
    last = corpus_pipeline.run(spark, tiny)
    assert {r.doc_id for r in last.collect()} == kept
    bad = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & kept) <= 0.1 * len(bad) + 1


def test_pipeline_of_nothing(spark, tiny):
    step = spark.read.parquet(f"{tiny}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, tiny)
        assert step.count() == 0


def test_pipeline_keeps_rows_without_id_and_extra_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("rejected_id", F.lit(1))
    out = corpus_pipeline.exact(spark, docs, tiny)
    assert out.columns == docs.columns


def test_pipeline_stages_equal_brute_force(spark, tiny):
    """Every stage against plain Python over the rows it was given, with ids, copies, nulls, empty and long texts added."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [r.text for r in docs.orderBy("doc_id").limit(4).collect()]
    long = " ".join(texts) * 40
    more = [(10_001, None), (10_002, ""), (10_003, texts[0]), (10_004, texts[0]), (10_005, texts[1] + " added words here"), (10_006, long), (10_007, long + " end"), (10_008, " \n")]
    step = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema)).withColumn("component_id", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.read.parquet(f"{tiny}/labels.parquet")

    def rows(df):
        return {r.doc_id: r.text for r in df.collect()}

    def quality(given, df):
        model = quality_rules.fit(df, labels)
        margin = lambda x: model.bias + sum(r.weight for r in model.rules if all((x[n] > at) == above for n, above, at in r.parts))
        values = {i: dict(zip(quality_rules.STATISTICS, quality_rules.statistics(t or ""), strict=True)) for i, t in given.items()}
        return {i for i, x in values.items() if 1 / (1 + np.exp(-margin(x))) >= corpus_pipeline.QUALITY_SCORE}

    def language(given, df):
        model = language_id.fit(df)
        told = {i: model.predict(t or "") for i, t in given.items()}
        return {i for i, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.LANGUAGE_SCORE}

    def exact(given, df):
        last = {}
        for i, t in sorted(given.items()):
            last[t or ""] = i
        return set(last.values())

    def near(given, df):
        return {i for i, (_, c) in brute_components(list(given.items()), 5, 80).items() if i == c}

    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], (quality, language, exact, near), strict=True):
        given = rows(step)
        kept = stage(spark, step, tiny)
        assert kept.columns == step.columns
        assert set(rows(kept)) == brute(given, step), stage
        step = cut(kept)
    library, given = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows(step)
    places, pieces = defaultdict(list), defaultdict(int)
    for r in sorted(corpus_pipeline.STAGES[-1][1](spark, step, tiny).collect(), key=lambda r: (r.doc_id, r.piece)):
        ids = library.encode(given[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert r.start == pieces[r.doc_id]
        pieces[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in given.items()}
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def test_lasso_weights_are_optimal():
    """At the minimum the gradient of a weight is the penalty against its sign, and at most the penalty where it is 0."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, len(quality_rules.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 3] * (x[:, 1] > 0) + 0.3 * r.normal(size=400) > 0).astype(float)
    penalty = 0.01
    model = quality_rules.fit_rules(x, y, penalty=penalty)
    names = {n: i for i, n in enumerate(quality_rules.STATISTICS)}
    holds = lambda rule: np.logical_and.reduce([(x[:, names[n]] > at) == above for n, above, at in rule.parts])
    z = model.bias + sum(rule.weight * holds(rule) for rule in model.rules)
    error = 1 / (1 + np.exp(-z)) - y
    assert model.rules and abs(error.mean()) < 1e-3
    for rule in model.rules:
        assert abs((holds(rule) * error).mean() + np.sign(rule.weight) * penalty) < 1e-3
    assert ((z > 0) == y).mean() > 0.9


def test_conflicting_and_repeated_labels(spark, docs, labels):
    """Labels that disagree on an id are both learnt from; repeated ones count twice; the fit does not fail or depend on order."""
    ids = [r.doc_id for r in labels.orderBy("doc_id").limit(6).collect()]
    odd = spark.createDataFrame([(i, q, 0) for i in ids for q in (0, 1, 1)], "doc_id long, quality int, toxic int")
    one, two = labels.select("doc_id", "quality", "toxic").unionByName(odd), odd.unionByName(labels.select("doc_id", "quality", "toxic"))
    assert quality_rules.fit(docs, one) == quality_rules.fit(docs, two)


def test_ftrl_equals_plain_loops():
    """The regularised leader, one coordinate and class at a time."""
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(40, 5, replace=False)), r.random(5)) for _ in range(60)]
    y = r.integers(0, 3, 60)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.2, 1.0
    z, n, weight = defaultdict(float), defaultdict(float), None

    def weight(j, c):
        if abs(z[j, c]) <= l1:
            return 0.0
        return -(z[j, c] - np.sign(z[j, c]) * l1) / ((beta + n[j, c] ** 0.5) / alpha + l2)

    for epoch in range(3):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[i]
            logits = np.array([sum(v * weight(j, c) for j, v in zip(at, value, strict=True)) for c in range(3)])
            p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            old = {(j, c): weight(j, c) for j in at for c in range(3)}
            for j, v in zip(at, value, strict=True):
                for c in range(3):
                    g = v * (p[c] - (c == y[i]))
                    z[j, c] += g - ((n[j, c] + g * g) ** 0.5 - n[j, c] ** 0.5) / alpha * old[j, c]
                    n[j, c] += g * g
    got = language_id.ftrl(rows, y, 3)
    want = np.array([[weight(j, c) for c in range(3)] for j in range(40)])
    assert np.allclose(got[:40], want) and not got[40:].any() and (want == 0).any()


def test_n_grams_equal_plain_ones():
    text = "Ab, Ça\n123 漢字!"
    found = language_id.counts(text)
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(letters.split()) + " "
    assert found.sum() == sum(len(plain) - order + 1 for order in (1, 2, 3))
    assert (language_id.counts("ab ça 漢字") == found).all()


def test_languages_that_tie_and_repeated_rows(spark):
    """Equal evidence gives the first language by name; rows with the same id are predicted one by one."""
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    again = spark.createDataFrame([(1, "same words here", "x"), (1, "same words here", "x"), (1, "other", "x")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, round(r.score, 1)) for r in language_id.identify(again, model).collect()]
    assert len(got) == 3 and got[0] == got[1] and all(r[1] in "ab" for r in got)
    p = language_id.softmax(np.zeros(2))
    assert p.tolist() == [0.5, 0.5] and int(p.argmax()) == 0
