"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

A piece of the vocabulary holds the space mark only at its start and never a line feed, so no token crosses a
cut before a run of spaces or around a line feed: the count of a text is the sum over its pre-tokens. The first
tier is a compact table (one string of words, one array of lengths) of the pre-tokens that are most frequent in a
bounded sample of the texts; it is broadcast, and only saves work: any sample gives the same counts. What it
misses is encoded by the library and kept in a worker cache of fixed size.

A null text counts as empty: no bytes, no tokens. Rows that repeat an id are counted one by one; other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from strandloom.llm.bpe_automaton import CACHE_ENTRIES, Cache
from strandloom.llm.common import id_and_text, map_rows, small_batches

MARK = "\N{LOWER ONE EIGHTH BLOCK}"
#: A line feed, or spaces and what follows up to the next space or line feed.
PRE_TOKEN = regex.compile(rf"\n|[ {MARK}]+[^ \n{MARK}]*|[^ \n{MARK}]+").findall
#: Pre-tokens that one batch gives to the sample, rows of the sample, entries of the broadcast table (about 20 bytes each).
BATCH_WORDS, SAMPLE_ROWS, TABLE_ENTRIES = 5_000, 100_000, 50_000


class PieceCounter:
    """Token counts of one sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces) or len(self.model.encode(" a")) != len(self.model.encode(f"{MARK}a")):
            raise ValueError("pieces of this model cross pre-tokens")
        self.line_feed = self.lone(self.model.encode("\n"))
        self.lengths = Cache(self._length)

    @staticmethod
    def lone(ids: list[int]) -> int:
        return len(ids) - 1

    def _length(self, word: str) -> int:
        if word == "\n":
            return self.line_feed
        if word[0] in (" ", MARK):  # the library puts one space mark before every text
            return len(self.model.encode(word[1:])) if len(word) > 1 else 1
        return self.lone(self.model.encode("\n" + word)) - self.line_feed

    def count(self, text: str, lengths: dict[str, int]) -> int:
        return sum(map(lengths.__getitem__, PRE_TOKEN(" " + text))) if text else 0


def compact_table(rows: DataFrame, own: PieceCounter, sample_rows: int, entries: int) -> tuple[str, np.ndarray]:
    """Frequent pre-tokens of the first batches, as one string, and their lengths.

    Every batch gives its most frequent pre-tokens with counts; sample_rows of these rows are taken, which runs as
    few tasks as it needs and moves nothing between executors.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for text in batch.column(1).to_pylist():
            seen.update(PRE_TOKEN(" " + text))
        top = [(w, n) for w, n in seen.most_common(BATCH_WORDS) if w != "\n" and len(w) < 40]
        return {"word": [w for w, _ in top], "n": [n for _, n in top]}

    total: Counter = Counter()
    for row in map_rows(rows, kernel, "word string, n long").limit(sample_rows).collect():
        total[row.word] += row.n
    words = [w for w, _ in total.most_common(entries)]
    return "\n".join(words), np.array([own._length(w) for w in words], np.int32)


_LOADED: dict[str, PieceCounter] = {}
_TIERS: dict[str, Cache] = {}


def counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    spark = df.sparkSession
    small_batches(spark)
    rows = id_and_text(df, id_col, text_col)
    job = uuid.uuid4().hex
    frequent = spark.sparkContext.broadcast(compact_table(rows, counter(path), sample_rows, table_entries))

    def kernel(batch: pa.RecordBatch) -> dict:
        own = counter(path)
        if job not in _TIERS or len(_TIERS[job]) > CACHE_ENTRIES * 9 // 10:  # when nearly full, only the first tier stays
            _TIERS.clear()
            words, lengths = frequent.value
            _TIERS[job] = Cache(own._length)
            _TIERS[job].update(zip(words.split("\n") if words else [], lengths.tolist(), strict=True))
        tier = _TIERS[job]
        texts = batch.column(1).to_pylist()
        n = [own.count(t, tier) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(rows, kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
