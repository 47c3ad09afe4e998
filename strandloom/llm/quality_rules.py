"""Text quality by a sparse ensemble of rules.

Trees are boosted on statistics of labelled texts; every path from a root to a node becomes a rule, a conjunction
of comparisons; a lasso logistic regression keeps few of them; what is left is compiled into one Spark column
expression over the statistics. Fitting sees a bounded sample of the labelled rows (``max_rows``, the smallest
hashes of their ids), all else sees every row and whole texts.

A null text counts as empty and gets a score as any other. Without labelled rows all scores are 0.5; with one
label they are next to it. A text whose id has several labels counts once with each, and repeated ones count again.
Rows that repeat an id are scored one by one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, map_rows, small_batches

#: Labelled rows that a fit sees at most.
MAX_ROWS = 6_000

UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
SENTENCE, SYMBOLS = b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~"
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "sentence_marks", "symbols", "exclamations", "bars", "beyond_ascii",
    "distinct_words", "top_word", "repeats_next", "lines_per_word", "distinct_lines", "words_with_symbols", "period_words",
)


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for a whole text; shares of nothing are 0."""
    b = text.encode()
    words, lines = b.split(), [x for x in b.split(b"\n") if x]
    n, w = max(1, len(b)), max(1, len(words))
    share = lambda marks: 1 - len(b.translate(None, marks)) / n if b else 0.0
    upper, lower = share(UPPER), share(LOWER)
    counts = Counter(words)
    return [
        math.log1p(len(b)), math.log1p(len(words)), sum(map(len, words)) / w, upper / (upper + lower) if upper + lower else 0.0, share(DIGITS), share(SENTENCE), share(SYMBOLS),
        b.count(b"!") / n, b.count(b"|") / n, 1 - len(text) / n if b else 0.0,
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, len(lines) / w, len(set(lines)) / max(1, len(lines)),
        sum(n for x, n in counts.items() if x[-1] in SYMBOLS) / w, sum(n for x, n in counts.items() if x[-1] == 46) / w,
    ]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a column for each of STATISTICS, for every row."""
    small_batches(df.sparkSession)

    def kernel(batch: pa.RecordBatch) -> dict:
        values = [statistics(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {name: [v[i] for v in values] for i, name in enumerate(STATISTICS)}

    return map_rows(id_and_text(df, id_col, text_col), kernel, ", ".join(["doc_id long", *(f"{name} double" for name in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold) with its weight."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        margin = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, at in rule.parts:
                holds &= (F.col(name) > at) if above else (F.col(name) <= at)
            margin += F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def grow(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, depth: int, least: int, parts: tuple, found: list) -> np.ndarray:
    """A regression tree on the logistic gradient; adds the path to every node to found and returns the fitted values."""
    value = residual.sum() / (hessian.sum() + 1)
    best = (1e-6, None, None)
    if depth and len(x) >= 2 * least:
        for j in range(x.shape[1]):
            for at in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25), method="nearest")):
                low = x[:, j] <= at
                k = int(low.sum())
                if least <= k <= len(x) - least:
                    g, h = residual[low].sum(), hessian[low].sum()
                    gain = g * g / (h + 1) + (residual.sum() - g) ** 2 / (hessian.sum() - h + 1) - residual.sum() ** 2 / (hessian.sum() + 1)
                    best = max(best, (gain, j, float(at)), key=lambda b: b[0])
    if best[1] is None:
        return np.full(len(x), value)
    _, j, at = best
    out, low = np.empty(len(x)), x[:, j] <= at
    for side, above in ((low, False), (~low, True)):
        path = (*parts, (STATISTICS[j], above, at))
        found.append(path)
        out[side] = grow(x[side], residual[side], hessian[side], depth - 1, least, path, found)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, least: int = 20, penalty: float = 1e-3, rate: float = 0.5) -> RuleEnsemble:
    """Boosted trees give the rules, a lasso logistic regression their weights (accelerated proximal gradient)."""
    if not len(y):
        return RuleEnsemble(0.0, ())
    mean = (y.sum() + 0.5) / (len(y) + 1)
    margin, paths = np.full(len(y), math.log(mean / (1 - mean))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin += rate * grow(x, y - p, p * (1 - p), depth, least, (), paths)
    paths = list(dict.fromkeys(paths))
    z = np.ones((len(y), len(paths) + 1))
    for i, path in enumerate(paths):
        for name, above, at in path:
            column = x[:, STATISTICS.index(name)]
            z[:, i] *= column > at if above else column <= at
    step = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(600):
        new = ahead - step * z.T @ (1 / (1 + np.exp(-z @ ahead)) - y) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return RuleEnsemble(float(w[-1]), tuple(Rule(path, float(v)) for path, v in zip(paths, w[:-1], strict=True) if v))


def learnable(id_column: Column) -> Column:
    """Rows that may be learnt from: the others are held out."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fit on at most max_rows of the labelled rows that are not held out."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learnable(F.col("doc_id")))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # bounded by max_rows
    rows = with_statistics(texts).join(F.broadcast(sample), "doc_id").orderBy("doc_id", *STATISTICS, "y").limit(max_rows).collect()
    return fit_rules(np.array([row[1:-1] for row in rows], float).reshape(len(rows), len(STATISTICS)), np.array([row.y for row in rows], float))


def classify(docs: DataFrame, model: RuleEnsemble, at_least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of at_least on) of every row."""
    scored = with_statistics(docs, id_col, text_col).withColumn("score", model.score())
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
