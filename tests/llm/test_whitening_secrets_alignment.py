"""Whitening, secret scans and the alignment of tokenizers against plain versions, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import queries, secret_scan, token_alignment, whitening
from strandloom.llm.bpe_automaton import byte_symbols

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHES = "row string, pair string, n string, d string, spans string, text_of string"
ROWS = [
    (1, None), (2, ""), (3, "the cat sat <|endoftext|> on the mat"), (4, "x▁y"), (5, " \n\t é 漢字 😀 don't  stop \n\n  "), (5, "again the cat"),
    (None, "a\0b <s> z"), (7, "word " * 3000), (8, "ﬁ ① <0x0A> <unk>"), (9, "ᣠ8 \U00018e08中"), (3, "the cat sat <|endoftext|> on the mat"),
]


def texts_of(spark, tiny, n):
    return [(r.doc_id + 1_000, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").limit(n).collect()]


# Alignment


def plain_tokens(text, a, b, symbols):
    """(ids, ranges) of both tokenizers, or nothing."""
    out = []
    for ids, label in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(symbols[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        labels = [label(i) for i in ids]
        if not text or b"".join(labels) != (" " + text).encode():
            return [], [], [], []
        ranges, at = [], 0
        for x in labels:
            ranges.append((at, at + len(x)))
            at += len(x)
        out += [ids, ranges]
    return out


def plain_alignment(rows, links):
    a, b, symbols = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_symbols()
    a.encode_special_tokens = True
    every, counts, out = [], Counter(), []
    for i, text in rows:
        ids_a, ra, ids_b, rb = plain_tokens(text or "", a, b, symbols)
        start, groups = 0, []
        for end in sorted({e for _, e in ra} & {e for _, e in rb}):
            inside = lambda ranges, start=start, end=end: [k for k, (s, e) in enumerate(ranges) if start <= s and e <= end]
            groups.append((inside(ra), inside(rb)))
            start = end
        linked = {
            "ends": lambda x, y: ra[x][1] == rb[y][1], "overlaps": lambda x, y: ra[x][0] < rb[y][1] and rb[y][0] < ra[x][1], "groups": lambda x, y: True,
        }[links]
        found = [(ids_a[x], ids_b[y]) for g, h in groups for x in g for y in h if linked(x, y)]
        written = ";".join(",".join(str(ids_a[x]) for x in g) + "|" + ",".join(str(ids_b[y]) for y in h) for g, h in groups)
        counts.update(found)
        every.append(found)
        out.append([-1 if i is None else i, len(ids_a), len(ids_b), len(groups), len(found), hashlib.sha256(written.encode()).hexdigest() if ids_a else ""])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted((*o[:5], sum(counts[p] == best[p[1]] for p in found), sum(counts[p] for p in found), o[5]) for o, found in zip(out, every, strict=True))


@pytest.mark.parametrize("links,frequent,block", [("ends", 1 << 18, 1 << 20), ("ends", 20, 300), ("overlaps", 100, 1), ("groups", 50, 1_000)])
def test_alignment_equals_plain_version(spark, tiny, monkeypatch, links, frequent, block):
    """With all pairs broadcast or most of them joined, and whatever the size of a block."""
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    rows = [r for r in ROWS if r[0] != 7] + texts_of(spark, tiny, 40)
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], f"doc_id long, text string, {CLASHES}").repartition(5)
    got = token_alignment.alignment(df, BPE, PIECES, links, frequent=frequent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == plain_alignment(rows, links)


def test_alignment_of_long_texts_and_of_none(spark):
    rows = [(1, "word " * 60_000 + "é" * 2_000), (2, "x" * 50_000)]
    (one, two) = token_alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string"), BPE, PIECES).orderBy("doc_id").collect()
    assert one.n_groups > 60_000 and two.n_groups >= 1
    assert token_alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECES).count() == 0
    with pytest.raises(ValueError):
        token_alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"), BPE, PIECES, "starts")


def test_products_of_groups():
    a, b = token_alignment.products(np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2, 2]), 3)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 3), (3, 4)]


# Secrets


BASE = {  # as the contract has them: matches that are too short are dropped afterwards
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def plain_base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, long)) in enumerate(BASE.items()) for m in p.finditer(text or "") if long(m)]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def random_texts(seed, n):
    r = random.Random(seed)
    parts = [
        "password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", ": ", "= ", "AKIA", "AKIAAKIA", "ASIA",
        "ABCD1234", "0123456789abcdef", "deadbeef" * 4, "x", "é", "😀", "\n", "\n\n", "\n \n", "user", "login", "user_id", "https://a.example/p", "ftp://u:p4ss@h.example",
        "10.0.0.1:8080", "aB3" * 8, "k9Qz7LmX2vRt5WnY8bHc", "pwd", "passphrase", "hunter2", "value12345", "host", "access_key_id", "private-key",
    ]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def plain_weak(text, reach):
    """Every weak candidate against every part, one pair at a time."""
    found = secret_scan.strong(text)
    candidates = secret_scan.weak(text, found)
    parts = {role: list(spans) for role, spans in candidates.items()}
    if not parts:
        return set()
    parts["identifier"] += found["access"]
    parts["secret"] += found["assign"] + found["hex"]
    cuts = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    block = lambda s: sum(c < s for c in cuts)

    def near(span, role):
        gap = lambda o: max(0, o[0] - span[1], span[0] - o[1])
        return any(gap(o) <= reach and block(o[0]) == block(span[0]) for o in secret_scan_merged(parts[role], block))

    needs = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}
    return {(role, *s) for role, spans in candidates.items() for s in spans if all(near(s, other) for other in needs[role])}


def secret_scan_merged(spans, block):
    return [(s, e) for s, e, _ in secret_scan.merged([(s, e, block(s)) for s, e in spans])]


@pytest.mark.parametrize("reach", [0, 15, 200])
def test_secrets_equal_plain_version(reach):
    texts = random_texts(1, 3_000)
    seen = Counter()
    for text, row in zip(texts, secret_scan.scan(texts, reach), strict=True):
        assert [f"{k}:{s}:{e}" for k, s, e, _ in row if k in secret_scan.STRONG] == plain_base(text), repr(text)
        assert {r[:3] for r in row if r[0] in secret_scan.ROLES} == plain_weak(text, reach), repr(text)
        assert row == sorted(row, key=lambda r: (r[1], secret_scan.KINDS.index(r[0])))
        seen.update(r[0] for r in row)
    assert all(seen[k] > 20 for k in secret_scan.STRONG) and (reach < 15 or all(seen[k] > 20 for k in secret_scan.KINDS))


def test_weak_parts_need_their_complement():
    kinds = lambda text: [(k, text[s:e]) for k, s, e, _ in secret_scan.scan([text])[0]]
    assert kinds("username: bob and some words") == [] == kinds("pwd=x9!k2 alone") == kinds("see https://a.example/b")
    both = "username: bob\npwd = x9!k2\nhost=db.example:5432"
    assert kinds(both) == [("identifier", "username: bob"), ("secret", "pwd = x9!k2"), ("endpoint", "host=db.example:5432")]
    assert kinds(both.replace("\n", "\n\n", 1)) == []  # a blank line ends the scope
    assert kinds("username: bob" + " word" * 60 + " pwd = x9!k2") == []  # too far apart
    assert kinds("postgres://app:s3cr@db.example/x") == [("identifier", "app"), ("secret", "s3cr"), ("endpoint", "db.example/x")]
    assert kinds("ASIA" + "Q" * 16 + " k9Qz7LmX2vRt5WnY8bHc") == [("identifier", "ASIA" + "Q" * 16), ("secret", "k9Qz7LmX2vRt5WnY8bHc")]
    assert [r[3] for r in secret_scan.scan([both])[0]] == [14, 0, 0]


def test_secret_digests(spark, tiny):
    rows = ROWS + [(20, "token=" + "a" * 40), (21, "é AKIA" + "X" * 12 + " user=root pwd:abcd"), (22, "0" * 200_000), (23, "password: " * 20_000)]
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], f"doc_id long, text string, {CLASHES}")
    got = secret_scan.digests(secret_scan.secret_spans(df)).collect()
    want = []
    for i, text in rows:
        base = plain_base(text)
        counts = Counter(x.split(":")[0] for x in base)
        want.append((-1 if i is None else i, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5]) for r in got) == sorted(want)
    assert {r.doc_id: r.spans for r in got}[21] == "access:2:18,identifier:19:28,secret:29:37"
    assert secret_scan.digests(secret_scan.secret_spans(df.limit(0))).count() == 0
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    empty = F.sha2(F.lit(""), 256)
    assert queries.op12_secret_scan(spark, tiny).where((F.col("spans") != "") | (F.col("base_sha256") == empty)).count() == docs.count()


# Whitening


def plain_whitening(rows, most):
    """vec_id -> (z, whitened, explained) of each row, from Python's integers."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in kept}:
        fit = sorted({tuple(x) for _, x in kept if len(x) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = lambda x, n=n, sums=sums: [n * c - s for c, s in zip(x, sums, strict=True)]
        z = np.array([centred(x) for x in fit], object)
        v = np.array([[int(c) / n**3 for c in row] for row in z.T @ z])
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = min(most, int((values > d * np.finfo(float).eps * values[0]).sum()) if values[0] > 0 else 0)
        for i, x in kept:
            if len(x) == d:
                w = (np.array(centred(x), float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
                out += [(i, c + 1, n, sum(q * q for q in centred(x)), abs(w[c]), values[c] / np.trace(v)) for c in range(k)]
    return sorted(out, key=lambda r: (-1 if r[0] is None else r[0], *r[1:]))


def vectors(seed):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(size=10) * np.arange(1, 11) * 0.2).tolist()) for i in range(200)]
    rows += rows[:4] + [(300 + i, rows[3][1]) for i in range(60)] + [(None, [0.5] * 10)]
    rows += [(400, None), (401, []), (402, [None] * 10), (403, [float("nan")] + [0.0] * 9), (404, [float("-inf")] * 10), (405, [0.25] * 3)]
    return rows + [(500 + i, r.normal(size=3).tolist()) for i in range(5)] + [(600 + i, (r.normal(size=2) * 1e15).tolist()) for i in range(30)]


@pytest.mark.parametrize("most,partitions", [(16, 3), (4, 9)])
def test_whitening_equals_plain_version(spark, most, partitions):
    rows = vectors(1)
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], f"vec_id long, embedding array<float>, {CLASHES}").repartition(partitions)
    got = sorted(whitening.whiten(df, most).collect(), key=lambda r: (-1 if r.vec_id is None else r.vec_id, *r[1:4], abs(r.whitened)))
    want = plain_whitening(rows, most)
    assert [(r.vec_id, r.component, r.n, int(r.deviation)) for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r.whitened) for r in got], [r[4] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_equal_vectors_and_of_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(i, [1.0] * i) for i in range(1, 30)], schema))


def test_whitening_query(spark, tiny):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    got = sorted(queries.op11_whitening(spark, tiny).collect(), key=lambda r: (r.vec_id, r.component))
    want = plain_whitening(rows, 16)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r.whitened) for r in got], [r[4] for r in want], rtol=1e-8, atol=1e-9)
    for component in range(1, 17):  # one sign for all rows
        own = [r.whitened for r in got if r.component == component]
        assert abs(np.mean(own)) < 0.2


def test_residues_give_integers_back():
    r = random.Random(2)
    for bound in (1, 10**6, 2**64, 10**40):
        moduli = whitening.primes(2 * bound)
        values = [r.randint(-bound, bound) for _ in range(50)] + [bound, -bound, 0]
        residues = np.array([[v % p for v in values] for p in moduli], np.int64)
        assert whitening.from_residues(residues, moduli) == values
    assert all(2 * (p - 1) ** 2 * whitening.ROWS < 2**54 for p in whitening.primes(10**40))


def test_sums_of_residues_are_of_many_tasks():
    """Sums of residues, not reduced, as tasks add them up."""
    moduli = whitening.primes(10**20)
    parts = [[5, -7, 10**9], [12, 10**8, -3]]
    residues = sum(np.array([[v % p for v in part] for p in moduli], np.int64) for part in parts)
    assert whitening.from_residues(residues, moduli) == [17, 10**8 - 7, 10**9 - 3]
