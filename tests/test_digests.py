"""Murmur3 against published values and a plain version."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import digests

M = 0xFFFFFFFF


def plain(seed, values):
    """Values one after the other in plain numbers: ("i", 32 bits), ("l", 64 bits) or ("t", bytes)."""
    words = []
    for kind, v in values:
        if kind == "t":
            words += [len(v) >> 32, len(v) & M]
            x = 0
            for i, c in enumerate(v):
                x = (x << 8 & M) | (c if c < 128 else 0xFFFFFF00 | c)
                if i % 4 == 3:
                    words.append(x)
                    x = 0
            words.append(x)
        else:
            words += ([v >> 32 & M] if kind == "l" else []) + [v & M]
    h = seed
    for k in words:
        k = k * 0xCC9E2D51 & M
        k = ((k << 15 | k >> 17) & M) * 0x1B873593 & M
        h ^= k
        h = (((h << 13 | h >> 19) & M) * 5 + 0xE6546B64) & M
    r = h ^ (4 * len(words) & M)
    r = (r ^ r >> 16) * 0x85EBCA6B & M
    r = (r ^ r >> 13) * 0xC2B2AE35 & M
    return r ^ r >> 16


def test_published_values():
    """Of the usual digest of bytes: texts of whole words in little-endian order, and empty ones."""
    for seed, data, want in (
        (0, b"", 0), (1, b"", 0x514E28B7), (M, b"", 0x81F16F39), (0, b"\xff" * 4, 0x76293B50), (0, b"!Ce\x87", 0xF55B516B),
        (0x5082EDEE, b"!Ce\x87", 0x2362F9DE), (0, b"\0" * 4, 0x2362F9DE), (0, b"test", 0xBA6BD213),
    ):
        h = np.array([seed], np.uint32)
        for word in np.frombuffer(data, "<u4"):
            h = digests.mixed(h, np.array([word], np.uint32))
        assert digests.finished(h, np.array([len(data)]))[0] == want


def test_chained_states(spark):
    rng = random.Random(4)
    rows = [(i, rng.randbytes(rng.choice([0, 1, 2, 3, 4, 5, 8, 31, 400])), rng.getrandbits(64) - 2**63, rng.getrandbits(32) - 2**31) for i in range(300)]
    rows += [(300, None, 1, 1), (301, b"x", None, 1), (302, b"ACGT" * 30_000 + b"\xe9", 0, -1)]
    df = spark.createDataFrame(rows, "i long, t binary, l long, n int").repartition(3)
    state = digests.with_long(digests.with_text(digests.start(9), F.col("t")), F.col("l"))
    kept = df.select("i", "t", "n", state.alias("state"))  # what another job goes on from
    got = {r.i: r.d for r in kept.select("i", digests.digest(digests.with_int(digests.with_text(F.col("state"), F.col("t")), F.col("n"))).alias("d")).collect()}
    for i, t, l, n in rows:
        assert got[i] == (None if t is None or l is None else plain(9, [("t", t), ("l", l), ("t", t), ("i", n)]))
    texts = spark.createDataFrame([("é",), ("",)], "s string").select(digests.digest(digests.with_text(digests.start(), F.col("s"))).alias("d")).collect()
    assert [r.d for r in texts] == [plain(0, [("t", "é".encode())]), plain(0, [("t", b"")])]
    assert df.where("false").select(digests.digest(digests.with_text(digests.start(), F.col("t")))).count() == 0
