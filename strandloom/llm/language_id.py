"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, what is no letter becomes one space, and n-grams of one to three characters are hashed to
``2 ** BITS`` features. Weights are trained by follow-the-regularised-leader (FTRL-proximal) with L1 and L2
penalties, so most are exactly zero; a temperature fitted on a part of the sample that training did not see then
calibrates the probabilities. Training sees a bounded sample: about ``per_language`` rows of each language, by
hashes of their ids. Prediction sees every row and whole texts.

A null text or one without letters is predicted ``und`` with score 0; so is every text where nothing could be
learnt. Languages that tie go to the first by name. The model has a weight for each feature and language, and the
sample rows for each language, so both are bounded by the number of languages, which is taken to be some hundreds at
most. Rows that repeat an id are predicted one by one; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, map_rows, small_batches
from strandloom.llm.quality_rules import learnable

BITS, ORDERS = 15, 3
#: Rows of each language that training sees, about.
PER_LANGUAGE = 300
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, 32)
    code = code[is_letter | np.append(False, is_letter[:-1])]  # of what is no letter, the first after a letter stays
    code = np.concatenate(([32], code, [32] if code[-1] != 32 else [])).astype(np.uint64)
    h, out = np.zeros(len(code), np.uint64), np.zeros(1 << BITS, np.int64)
    with np.errstate(over="ignore"):
        for order in range(min(ORDERS, len(code))):
            h = h[: len(code) - order] * np.uint64(0x9E3779B97F4A7C15) + code[order:] + np.uint64(order + 1)
            out += np.bincount(((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNDETERMINED, 0.0
        x = found * self.idf
        p = softmax(x @ self.weights / (math.sqrt(float(x @ x)) or 1.0) / self.temperature)
        return self.languages[int(p.argmax())], min(1.0, float(p.max()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 1.0) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal with per-coordinate rates over sparse rows (indices, values)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[i]
            w = weights(at)
            error = softmax(value @ w)
            error[y[i]] -= 1
            g = value[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a logarithmic grid; each row counts as one that may be mislabelled."""
    grid, doubt = np.exp(np.linspace(math.log(0.01), math.log(5), 120)), 1 / (len(y) + 2)
    target = np.full(logits.shape, doubt / logits.shape[1])
    target[np.arange(len(y)), y] += 1 - doubt
    loss = [-(target * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from rows with a language that are not held out; their number is bounded by per_language."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    totals = {row.lang: row.n for row in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as languages
    languages = tuple(sorted(totals))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((0, 0)), 1.0)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, 1.2 * per_language / totals[lang])))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = named.where(chance < share[F.col("lang")])

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "lang": [], "at": [], "n": []}
        for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (found := counts(text)) is not None:
                at = np.flatnonzero(found)
                for name, value in zip(out, (doc_id, lang, at.astype(np.int32).tobytes(), found[at].astype(np.int32).tobytes()), strict=True):
                    out[name].append(value)
        return out

    rows = map_rows(sample, kernel, "doc_id long, lang string, at binary, n binary").orderBy(F.xxhash64("doc_id"), "doc_id", "at", "n").limit(2 * per_language * len(languages)).collect()
    at = [np.frombuffer(row["at"], np.int32).astype(np.int64) for row in rows]
    idf = np.log((1 + len(rows)) / (1 + np.bincount(np.concatenate([*at, np.zeros(0, np.int64)]), minlength=1 << BITS))) + 1
    x = []
    for i, row in enumerate(rows):
        value = np.frombuffer(row["n"], np.int32) * idf[at[i]]
        x.append((at[i], value / np.linalg.norm(value)))
    y = np.array([languages.index(row.lang) for row in rows], int)
    seen = len(x) - len(x) // 5  # the last fifth is kept for the temperature
    weights = ftrl(x[:seen], y[:seen], len(languages))
    logits = np.array([v @ weights[i] for i, v in x[seen:]])
    return LanguageModel(languages, idf, weights, calibrate(logits, y[seen:]) if len(logits) else 1.0)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: features x languages

    def kernel(batch: pa.RecordBatch) -> dict:
        found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    out = map_rows(id_and_text(docs, id_col, text_col), kernel, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
