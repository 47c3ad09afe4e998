"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

How pieces share sequences depends on their lengths alone, and there are no more lengths than the capacity. So
the plan is made from the number of pieces of each length, which no input size makes longer, and says for runs of
ranks within a length which sequences and offsets they get. Pieces above one third of the capacity are matched
greedily, at most two to a sequence; the smaller ones go, longest first, into the smallest gap that holds them.
Ranks within a length are dealt out without a global order: counts per (bucket, length) are summed over buckets,
and a piece's rank is its place in its bucket after the pieces of the buckets before.

A null or empty text still has the closing id 0. Rows that repeat an id are packed one by one. Pieces of one length
are alike to the plan: which of them takes which place of that length is open, and changes no number of sequences. No
rows, no sequences.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.bpe_automaton import automaton
from strandloom.llm.common import cut, id_and_text, map_rows, small_batches

CAPACITY, CLOSING_ID = 2048, 0


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the closing one, cut only if over the capacity.

    The first piece of a cut document is the short one, so that all others fill a sequence.
    """
    small_batches(df.sparkSession)

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = automaton(path).encode(text) + CLOSING_ID.to_bytes(4, "little")
            n = len(ids) // 4
            at, piece = 0, 0
            while at < n:
                end = at + ((n - at) % capacity or capacity)
                for name, value in (("doc_id", doc_id), ("piece", piece), ("start", at), ("length", end - at), ("ids_crc32", zlib.crc32(memoryview(ids)[4 * at : 4 * end]))):
                    out[name].append(value)
                at, piece = end, piece + 1
        return out

    return map_rows(id_and_text(df, id_col, text_col), kernel, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) rows that place every piece of the histogram once."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    sequences = 0

    def place(n: int, count: int, first: int) -> None:
        placed.append((n, used[n], count, first, offset))
        used[n] += count
        left[n] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if left[m] and m <= capacity - n and (m != n or left[n] > 1)), None)  # the largest that fits
            count = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            first, sequences = sequences, sequences + count
            offset = 0
            place(n, count, first)
            gap = capacity - n
            if mate is not None:
                offset = n
                place(mate, count, first)
                gap -= mate
            if gap:
                gaps.setdefault(gap, []).append((first, count))
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                per = capacity // n  # new sequences are filled with this length as far as it goes
                count = max(1, left[n] // per)
                gaps.setdefault(capacity, []).append((sequences, count))
                sequences += count
                continue
            first, have = gaps[gap].pop()
            count = min(have, left[n])
            if have > count:
                gaps[gap].append((first + count, have - count))
            if not gaps[gap]:
                del gaps[gap]
            offset = capacity - gap
            place(n, count, first)
            if gap > n:
                gaps.setdefault(gap - n, []).append((first, count))
    return placed


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """cut_pieces with sequence_id and offset: every piece once, offsets without gaps from 0, no sequence over capacity."""
    spark = cut_pieces.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    per_bucket = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {row.length: row.n for row in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    placed = spark.createDataFrame(plan(counts, capacity), "length long, first_rank long, ranks long, first_sequence long, offset long")
    runs = placed.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "ranks", "first_sequence", "offset"))).alias("runs"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_bucket.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start")) - 1
    ranked = rows.withColumn("local", local).join(starts, ["bucket", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    run = F.element_at(F.filter("runs", lambda r: (r.first_rank <= F.col("rank")) & (F.col("rank") < r.first_rank + r.ranks)), 1)
    return (
        ranked.join(F.broadcast(runs), "length")  # bounded by the capacity: one row for each length
        .withColumn("run", run)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.first_sequence") + F.col("rank") - F.col("run.first_rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))
    )
