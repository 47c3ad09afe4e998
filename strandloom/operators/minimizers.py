"""K-mers of reads looked up in a large set, by minimizers.

The minimizer of a k-mer is the least of its m-mers under a mixing function. Neighbouring k-mers of a read mostly share
it, so they travel as one piece of the read, packed four bases to a byte, to the bucket of their minimizer; members go
to the bucket of theirs. A task gets the members of a bucket first and then streams the pieces past them, so it holds
no more than one bucket's members and one batch. Buckets that hold more than their share of pieces are split by a hash
of the piece, with their members sent to every part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from strandloom.operators.kmers import OUT_ROWS, window_codes

#: Bases of a minimizer; buckets; parts of a bucket that has more than CROWDED times its share of pieces.
M, BUCKETS, PARTS, CROWDED = 7, 1 << 12, 16, 4
#: Bits for the bases of a piece beside its place; a sequence is walked in parts of fewer.
SIZE_BITS = 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = np.full(256, 0, np.uint8)
for _i, _letter in enumerate(b"ACGT"):
    _BASES[_letter] = _BASES[_letter + 32] = _i
_FOUR = np.array([[i >> 6, i >> 4 & 3, i >> 2 & 3, i & 3] for i in range(256)], np.uint8)


def minimizers(codes: np.ndarray, k: int, m: int = M) -> np.ndarray:
    """The minimizers of k-mers, mixed."""
    m = min(m, k)
    codes, mask, best = codes.astype(np.uint64), np.uint64((1 << 2 * m) - 1), None
    for i in range(k - m + 1):
        mixed = (codes >> np.uint64(2 * i) & mask) * _MIX
        mixed ^= mixed >> np.uint64(29)
        best = mixed if best is None else np.minimum(best, mixed)
    return best if best is not None else np.empty(0, np.uint64)


def buckets(codes: np.ndarray, k: int) -> np.ndarray:
    return (minimizers(codes, k) * _MIX >> np.uint64(40)).astype(np.int64) % BUCKETS


def packed(base: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of bases, four to a byte; the last byte of each is filled up."""
    size = -(-lengths // 4)
    ends = np.cumsum(size) * 4
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - 4 * size, 4 * size)
    at = np.repeat(starts, 4 * size) + nth
    four = np.where(nth < np.repeat(lengths, 4 * size), base[np.minimum(at, max(len(base) - 1, 0))], 0).reshape(-1, 4)
    data = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8)
    cuts = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def unpacked(pieces: pa.Array, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The piece, the place in it and the code of every k-mer of packed runs."""
    base = _FOUR[np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)].ravel().astype(np.int64)
    size = -(-lengths // 4) * 4
    first = np.cumsum(size) - size
    windows = lengths - k + 1
    piece = np.repeat(np.arange(len(lengths)), windows)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at, codes = first[piece] + nth, np.zeros(len(piece), np.int64)
    for i in range(k):
        codes = codes << 2 | base[at + i]
    return piece, nth, codes


def super_kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """df's other columns, bucket, pos, bases, piece: runs of k-mers of the column seq that share a minimizer."""
    keys = [c for c in df.columns if c != seq]
    added = [StructField("bucket", IntegerType()), StructField("pos", LongType()), StructField("bases", IntegerType()), StructField("piece", BinaryType())]
    schema = StructType([df.schema[c] for c in keys] + added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                for begin in range(0, max(1, len(text or "") - k + 1), 1 << 20):
                    part = (text or "")[begin : begin + (1 << 20) + k - 1]
                    starts, codes, _ = window_codes(part, k)
                    if not len(starts):
                        continue
                    least = minimizers(codes, k)
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (least[1:] != least[:-1]))))
                    windows = np.diff(np.append(new, len(starts)))
                    at = starts[new]
                    base = _BASES[np.frombuffer(part.encode("ascii", "replace"), np.uint8)]
                    own = [pa.array(buckets(codes[new], k), pa.int32()), pa.array(at + begin), pa.array(windows + k - 1, pa.int32()), packed(base, at, windows + k - 1)]
                    kept = [c.take(pa.array(np.full(len(at), row))) for c in batch.columns[: len(keys)]]
                    yield pa.RecordBatch.from_arrays([*kept, *own], names=schema.names)

    return df.select(*keys, seq).mapInArrow(run, schema)


def looked_up(df: DataFrame, seq: str, k: int, members: DataFrame, *, positions: bool = False) -> DataFrame:
    """The rows of ``kmers.kmers`` whose kmer is one of members (distinct kmer), for any number of members."""
    keys = [c for c in df.columns if c != seq]
    pieces = super_kmers(df, seq, k)
    sizes = pieces.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row for each of BUCKETS
    share = sum(r.n for r in sizes) / BUCKETS
    crowded = [r.bucket for r in sizes if r.n > max(CROWDED * share, 1_000)]
    split = F.col("bucket").isin(crowded) if crowded else F.lit(False)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(buckets(codes, k), pa.int32()), batch.column(0)], names=["bucket", "member"])

    # A row of the one shuffle: its cell, and a member or else the place and size of a piece, which share a column.
    placed = members.where(F.col("kmer").isNotNull()).select("kmer").mapInArrow(place, "bucket int, code long")
    cell = lambda part: (F.col("bucket") * PARTS + part).cast("int").alias("cell")
    every = F.explode(F.sequence(F.lit(0), F.when(split, F.lit(PARTS - 1)).otherwise(F.lit(0)))).alias("part")
    own = placed.select("bucket", "code", every).select(cell(F.col("part")), "code")
    pos = F.shiftleft("pos", SIZE_BITS) if positions else F.lit(0)  # what is not asked for is not moved
    code = (pos + F.col("bases")).cast("long").alias("code")
    part = F.when(split, F.pmod(F.xxhash64("piece", "pos"), F.lit(PARTS))).otherwise(0)
    both = own.unionByName(pieces.select(cell(part), code, "piece", *keys), allowMissingColumns=True).select("cell", "code", "piece", *keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "cell").sortWithinPartitions("cell", F.col("piece").isNotNull(), "code")
    added = [StructField("kmer", LongType()), *[StructField("pos", LongType())] * positions]
    schema = StructType([df.schema[c] for c in keys] + added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, known = None, [], np.empty(0, np.int64)
        for whole in batches:
            cell, member = whole.column(0).to_numpy(), whole.column(2).is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(member.astype(int)) != 0)) + 1).tolist(), len(cell)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(start, stop - start)
                if cell[start] != here:
                    here, held, known = cell[start], [], np.empty(0, np.int64)
                if member[start]:  # members come first, in order
                    held.append(batch.column(1).to_numpy())
                    continue
                if held:
                    known, held = np.concatenate(held), []
                if not len(known):
                    continue
                pos, lengths = np.divmod(batch.column(1).to_numpy(), 1 << SIZE_BITS)
                piece, nth, codes = unpacked(batch.column(2), lengths, k)
                hit = known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes
                for at in range(0, int(hit.sum()), OUT_ROWS):
                    some = np.flatnonzero(hit)[at : at + OUT_ROWS]
                    rows = pa.array(piece[some])
                    place = pa.array(pos[piece[some]] + nth[some])
                    kept = [c.take(rows) for c in batch.columns[3:]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(codes[some]), *[place] * positions], names=schema.names)

    return dealt.mapInArrow(run, schema)
