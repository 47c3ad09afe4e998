"""K-mers of sequences of any length as rows, and what is counted, looked up and joined by them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from strandloom.functions.kmers import checked
from strandloom.operators.ordered import numbered

_CODE = np.full(256, 4, np.uint8)
for _i, _letter in enumerate(b"ACGT"):
    _CODE[_letter] = _CODE[_letter + 32] = _i
#: For ``counted``: bytes after the first of a letter are no letters of their own.
_LEFT_OUT = 255
_BY_LETTER = _CODE.copy()
_BY_LETTER[0x80:0xC0] = _LEFT_OUT
#: Windows that are counted at a time, and cells of a table of counts, at most.
WINDOWS, CELLS = 1 << 20, 1 << 22
#: Rows of one Arrow batch that a kernel gives out, about.
OUT_ROWS = 1 << 16
#: K-mers of a reference that are broadcast, at most (8 bytes each).
MOST_MEMBERS = 1_000_000


def window_codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, codes and codes of the reverse complements of all valid windows of one sequence."""
    base = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    if len(base) < k:
        return (np.empty(0, np.int64),) * 3
    bad = np.concatenate(([0], np.cumsum(base > 3)))
    starts = np.flatnonzero(bad[k:] == bad[:-k])
    two, n = (base & 3).astype(np.int64), len(base) - k + 1
    forward, backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        forward = forward << 2 | two[i : i + n]
        backward |= (3 - two[i : i + n]) << (2 * i)
    return starts, forward[starts], backward[starts]


def kmers(
    df: DataFrame, seq: str, k: int, *, positions: bool = False, both_strands: bool = False, canonical: bool = False, among: Broadcast | None = None
) -> DataFrame:
    """One row for each valid window of the column seq, with df's other columns.

    Adds kmer (code), with both_strands rc (code of the reverse complement), with positions pos (0-based start) and
    with both also rc_pos (start on the other strand); canonical makes kmer the smaller of both codes. Sequences
    that are null or shorter than k give no rows. among: sorted codes, broadcast; other k-mers give no rows.
    """
    checked(k)
    keys = [c for c in df.columns if c != seq]
    added = ["kmer", *["rc"] * both_strands, *["pos"] * positions, *["rc_pos"] * (positions and both_strands)]
    if clash := set(keys) & set(added):
        raise ValueError(f"columns {sorted(clash)} are already there")
    schema = StructType([df.schema[c] for c in keys] + [StructField(c, LongType()) for c in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, parts = 0, []

            def out() -> pa.RecordBatch:
                rows = np.concatenate([np.full(len(p[1]), p[0], np.int64) for p in parts])
                starts, forward, backward, ends = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
                columns = {"kmer": np.minimum(forward, backward) if canonical else forward, "rc": backward, "pos": starts, "rc_pos": ends}
                kept = batch.select(range(len(keys))).take(pa.array(rows)) if keys else None
                return pa.RecordBatch.from_arrays([*(kept.columns if keys else []), *(pa.array(columns[c]) for c in added)], names=[*keys, *added])

            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                if text:
                    starts, forward, backward = window_codes(text, k)
                    if among is not None and len(starts):
                        codes = np.minimum(forward, backward) if canonical else forward
                        at = np.minimum(np.searchsorted(among.value, codes), len(among.value) - 1)
                        kept = among.value[at] == codes if len(among.value) else np.zeros(len(codes), bool)
                        starts, forward, backward = starts[kept], forward[kept], backward[kept]
                    for at in range(0, len(starts), OUT_ROWS):
                        piece = slice(at, at + OUT_ROWS)
                        parts.append((row, starts[piece], forward[piece], backward[piece], len(text) - k - starts[piece]))
                        held += len(parts[-1][1])
                        if held >= OUT_ROWS:
                            yield out()
                            held, parts = 0, []
            if parts:
                yield out()

    return df.select(*keys, seq).mapInArrow(run, schema)


def letter_codes(letters: str, as_bases: str) -> np.ndarray:
    """A table of bytes for ``counted``: letters (ASCII) stand for bases, in turn, and all else is left out."""
    out = np.full(256, _LEFT_OUT, np.uint8)
    for letter, base in zip(letters.encode(), as_bases.encode(), strict=True):
        out[letter] = _CODE[base]
    return out


def counted(df: DataFrame, seq: str, k: int, *, length: int | None = None, codes: np.ndarray | None = None) -> DataFrame:
    """df's other columns, [second,] pos, kmer, rc, n: how often each k-mer starts at each place of the column seq.

    As ``kmers`` with positions and both strands, counted, but a batch is counted before its k-mers are rows. length:
    sequences are cut into consecutive reads of that length, pos is the place in a read, no k-mer lies in two, and
    second says whether a read is the second of its pair (false, true, and so on, in turn). codes: what bytes stand for.
    """
    checked(k)
    table = _BY_LETTER if codes is None else codes
    keys = [c for c in df.columns if c != seq]
    added = [*["second"] * (length is not None), "pos", "kmer", "rc", "n"]
    if clash := set(keys) & set(added):
        raise ValueError(f"columns {sorted(clash)} are already there")
    schema = StructType([df.schema[c] for c in keys] + [StructField(c, BooleanType() if c == "second" else LongType()) for c in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, sample = np.zeros(batch.num_rows, np.int64), np.zeros(1, np.int64)
            for i in range(len(keys)):
                own = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                _, sample, group = np.unique(group * (int(own.max(initial=0)) + 1) + own, return_index=True, return_inverse=True)
            for groups, second, pos, forward, n in _tallies(batch.column(len(keys)), group, len(sample), k, length, table):
                backward = np.zeros(len(forward), np.int64)
                for i in range(k):
                    backward |= (3 - (forward >> (2 * i) & 3)) << (2 * (k - 1 - i))
                made = {"second": second, "pos": pos, "kmer": forward, "rc": backward, "n": n}
                kept = batch.select(range(len(keys))).take(pa.array(sample[groups])) if keys else None
                yield pa.RecordBatch.from_arrays([*(kept.columns if keys else []), *(pa.array(made[c]) for c in added)], names=[*keys, *added])

    parts = df.select(*keys, seq).mapInArrow(run, schema)
    return parts.groupBy(*keys, *added[:-1]).agg(F.sum("n").alias("n"))


def _tallies(seqs: pa.Array, group: np.ndarray, groups: int, k: int, length: int | None, table: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Group, whether in a second read, place, code and number of all that the sequences of a batch show, by slices of windows."""
    seqs = seqs.cast(pa.string())
    buffers = seqs.buffers()
    cuts = np.frombuffer(buffers[1], np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64) if len(seqs) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[cuts[0] : cuts[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    base = table[data]
    there = base != _LEFT_OUT
    cuts -= cuts[0]
    if not there.all():  # cuts by what stays
        full = np.add.reduceat(np.append(there, False), np.minimum(cuts[:-1], len(there)), dtype=np.int64) if len(seqs) else np.zeros(0, np.int64)
        full[cuts[1:] == cuts[:-1]] = 0
        base, cuts = base[there], np.concatenate(([0], np.cumsum(full)))
    width = int(np.diff(cuts).max(initial=0)) if length is None else length
    kinds = 1 if length is None else 2
    for low in range(0, max(len(base) - k + 1, 0), WINDOWS):
        high = min(low + WINDOWS, len(base) - k + 1)
        first, last = np.searchsorted(cuts, (low, high - 1), side="right") - 1
        edges = np.clip(cuts[first : last + 2], low, high)
        row = np.repeat(np.arange(first, last + 1), np.diff(edges))
        place = np.arange(low, high) - cuts[row]
        read = np.zeros(len(row), np.int64) if length is None else place // length
        end = cuts[row + 1] - cuts[row] if length is None else np.minimum(cuts[row + 1] - cuts[row], (read + 1) * length)
        piece = base[low : high + k - 1]
        good = place + k <= end
        code = np.zeros(high - low, np.int64)
        for i in range(k):
            one = piece[i : i + high - low]
            good &= one < 4
            code <<= 2
            code |= one & 3
        pos = place if length is None else place - read * length
        where = ((group[row] * kinds + read % kinds) * width + pos)[good]
        yield from _summed(where, code[good], groups * kinds * width, 4**k, width, kinds)


def _summed(where: np.ndarray, code: np.ndarray, places: int, codes: int, width: int, kinds: int) -> Iterator[tuple[np.ndarray, ...]]:
    if not len(where):
        return
    if places * codes <= CELLS:
        n = np.bincount(where * codes + code)
        found = np.flatnonzero(n)
        n = n[found]
        where, code = np.divmod(found, codes)
    elif places * codes < 1 << 62:
        found, n = np.unique(where * codes + code, return_counts=True)
        where, code = np.divmod(found, codes)
    else:
        order = np.lexsort((code, where))
        where, code = where[order], code[order]
        new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (code[1:] != code[:-1]))))
        n = np.diff(np.append(new, len(where)))
        where, code = where[new], code[new]
    group, pos = np.divmod(where, width)
    group, second = np.divmod(group, kinds)
    yield group, second == 1, pos, code, n.astype(np.int64)


def kmers_among(df: DataFrame, seq: str, k: int, members: DataFrame, *, positions: bool = False, most: int = MOST_MEMBERS) -> DataFrame:
    """The rows of ``kmers`` whose kmer is one of members (distinct kmer).

    Up to ``most`` members are broadcast as a sorted array and looked up where the k-mers are made, so that only hits
    leave a task. Whether they are that few is found by reading no more than one beyond; for more, pieces of the
    sequences travel to the members by their minimizers (``minimizers.looked_up``).
    """
    from strandloom.operators.minimizers import looked_up  # which is built on this module

    some = np.sort(members.select("kmer").limit(most + 1).toArrow().column(0).to_numpy())
    if len(some) <= most:
        return kmers(df, seq, k, positions=positions, among=df.sparkSession.sparkContext.broadcast(some))
    return looked_up(df, seq, k, members, positions=positions)


def spectrum(df: DataFrame, seq: str, k: int, canonical: bool = True) -> DataFrame:
    """kmer, n: how often each k-mer occurs in all sequences."""
    return kmers(df.select(seq), seq, k, canonical=canonical).groupBy("kmer").agg(F.count("*").alias("n"))


def annotate(df: DataFrame, kmer: str = "kmer", mask: str = "mask") -> DataFrame:
    """kmer, annot: the labels of each k-mer united by bit-or. Uniting two annotated sets is their union through this."""
    return df.groupBy(F.col(kmer).alias("kmer")).agg(F.bit_or(mask).alias("annot"))


def ranked(members: DataFrame, column: str = "kmer", parts: int | None = None) -> DataFrame:
    """Distinct members with rank (0-based, in ascending order of a column).

    Members are ranked range by range, in ranges that hold about as many each, however their values lie.
    """
    distinct = members.select(column).where(F.col(column).isNotNull()).distinct()
    places = numbered(distinct, column, out="_nth", parts=parts)
    return places.select(column, (F.col("_nth") - 1).cast("long").alias("rank"))


def select_rank(members: DataFrame, rank: int, column: str = "kmer") -> DataFrame:
    """The member of a rank, as one row or none."""
    return ranked(members, column).where(F.col("rank") == rank).select(column)


def contains(probes: DataFrame, members: DataFrame, column: str = "kmer") -> DataFrame:
    """probes with the boolean found: whether the value is a member."""
    marked = members.select(column).where(F.col(column).isNotNull()).distinct().withColumn("found", F.lit(True))
    return probes.join(marked, column, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def semi_join(df: DataFrame, members: DataFrame, column: str = "kmer") -> DataFrame:
    return df.join(members.select(column), column, "left_semi")


def disjoint_union(left: DataFrame, right: DataFrame, column: str = "kmer") -> DataFrame:
    """The union of two sets that must not share a member: a shared one raises an error when rows are read."""
    counted = left.select(column).distinct().unionByName(right.select(column).distinct()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("both sets hold "), F.col(column).cast("string"))).cast("boolean")).otherwise(True)).select(column)


def sampled(df: DataFrame, seed: int, probability: float, *by: str) -> DataFrame:
    """Rows drawn with a probability by a hash of the columns by, the same ones for the same seed at any partitioning."""
    if probability >= 1:
        return df
    draw = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(draw < probability)


def seed_and_probability(option: str) -> tuple[int, float]:
    """An option such as 17.25: seed 17, probability 0.25; 1.0 and whole numbers mean probability 1."""
    seed, _, fraction = option.partition(".")
    probability = float(f"0.{fraction}") if fraction.strip("0") else 1.0
    return int(seed or 0), probability
