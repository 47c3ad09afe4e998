"""What alignments say of the reference, base by base. Alignments: chrom, pos0, cigar array<struct<op, len>> or text, seq.

A batch of reads is walked as a whole: the run lengths of all CIGARs are expanded by repetition, their offsets are
running sums, and the bases are one gather from the bytes of all sequences. ``counted`` sums what a batch shows before
anything is shuffled, and shuffles a row for each stretch of BIN places, not one for each thing that is shown. Slices of
a batch are bounded by the bases that they show, so long reads need no more memory.

Reads without a place or a CIGAR show nothing. Bases beyond the end of a sequence are empty texts, those of a null
sequence are null; sequences are ASCII, and other letters count as ``?``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Flag bits of an alignment.
PROPER_PAIR, UNMAPPED, DUPLICATE = 0x2, 0x4, 0x400
MATCHES, ADVANCE_READ, ADVANCE_REFERENCE = ("M", "=", "X"), ("M", "=", "X", "I", "S"), ("M", "=", "X", "D", "N")
EMITS = ("alleles", "pileup", "depth")
#: Parts of what ``pileup`` shows.
PARTS = ("indels", "places")
#: Bases that a slice of a batch shows, about; a read that shows more is a slice of its own.
SHOWN = 1 << 20
#: Names of what is shown: single bytes, then an absent one; texts of insertions and deletions follow.
ABSENT = 256
#: Places of a stretch whose counts are one row of a shuffle, and what is kept there of each count: the place within the
#: stretch, the name (from ABSENT + 1 on, more by the length of its text) and the number.
BIN = 1 << 10
ENTRY = np.dtype([("at", "<u2"), ("name", "<i4"), ("n", "<i8")])


def parse_cigar(text: Column) -> Column:
    """A CIGAR string as an array of (op, len); a star is an empty one."""
    parts = F.filter(F.split(text, "(?<=[MIDNSHP=X])"), lambda x: x.rlike("^[0-9]+[MIDNSHP=X]$"))
    return F.transform(parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def _table(ops: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in ops]] = True
    return out


_MATCHED, _IN_READ, _IN_REFERENCE, _LISTED = map(_table, (MATCHES, ADVANCE_READ, ADVANCE_REFERENCE, tuple("MIDNSHP=X")))
_SYMBOL = np.full(257, ord("N"), np.int64)
for _letter, _as in zip("ACGTUacgtu", "ACGTTACGTT", strict=True):
    _SYMBOL[ord(_letter)] = ord(_as)


def letters(seq: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all sequences, and where each begins and how long it is; a null one is as long as none."""
    seq = seq.cast(pa.string())
    if seq.null_count or not _ascii(seq):
        seq = pa.array([(s or "").encode("ascii", "replace").decode() for s in seq.to_pylist()], pa.string())
    return bytes_of(seq)


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts or binary values without nulls, and where each begins and how long it is."""
    buffers = values.buffers()
    cuts = np.frombuffer(buffers[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, cuts[:-1], np.diff(cuts)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Runs of bytes as texts or binary values."""
    return cut_up(np.ascontiguousarray(data[gather(starts, lengths)]), lengths, kind)


def cut_up(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Texts or binary values that follow one another in data."""
    cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(data)])


def _ascii(seq: pa.Array) -> bool:
    data = seq.buffers()[2]
    return data is None or not (np.frombuffer(data, np.uint8) > 127).any()


def _operations(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many operations each CIGAR text has, their letters and their lengths; what is no number and letter is left out."""
    data, starts, sizes = letters(text)
    data = data[starts[0] : starts[-1] + sizes[-1]] if len(starts) else data[:0]
    of_text = np.repeat(np.arange(len(sizes)), sizes)
    digit = (data >= 48) & (data <= 57)
    marks, digits = np.flatnonzero(~digit), np.flatnonzero(digit)
    mark = np.searchsorted(marks, digits)  # the mark behind each digit
    inside = mark < len(marks)
    digits, mark = digits[inside], mark[inside]
    same = of_text[digits] == of_text[marks[mark]]
    digits, mark = digits[same], mark[same]
    value = (data[digits] - 48.0) * 10.0 ** (marks[mark] - digits - 1)
    known = (np.bincount(mark, minlength=len(marks)) > 0) & _LISTED[data[marks]]
    lengths = np.bincount(mark, value, len(marks)).astype(np.int64)
    return np.bincount(of_text[marks[known]], minlength=len(sizes)).astype(np.int64), data[marks[known]].astype(np.int64), lengths[known]


def operations(cigar: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many operations each CIGAR has, array or text, their letters and their lengths."""
    if not pa.types.is_list(cigar.type):
        return _operations(cigar)
    lengths = cigar.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cigar.flatten()
    names = flat.field(0).dictionary_encode()
    known = np.array([ord(x[0]) if x else 0 for x in names.dictionary.to_pylist()] or [0], np.int64)
    return lengths, known[names.indices.fill_null(0).to_numpy(zero_copy_only=False)], flat.field(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Walk:
    """The operations of a batch of reads, with the places in reference and read at which they begin."""

    def __init__(self, pos0: pa.Array, cigar: pa.Array, seq: pa.Array):
        lengths, self.op, self.len = operations(cigar)
        self.read = np.repeat(np.arange(len(lengths)), lengths)
        self.first = np.cumsum(lengths) - lengths  # operations before each read
        self.placed = pos0.is_valid().to_numpy(zero_copy_only=False)
        self.pos0 = pos0.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ref = self.pos0[self.read] + self._offsets(_IN_REFERENCE)
        self.at = self._offsets(_IN_READ)
        self.data, self.starts, self.sizes = letters(seq)
        self.known = seq.is_valid().to_numpy(zero_copy_only=False)

    def _offsets(self, moves: np.ndarray) -> np.ndarray:
        steps = np.where(moves[self.op], self.len, 0)
        before = np.cumsum(steps) - steps
        return before - before[np.minimum(self.first, max(len(before) - 1, 0))][self.read] if len(before) else before

    def slices(self, emit: str) -> Iterator[np.ndarray]:
        """Runs of operations that show about SHOWN bases, each with whole reads."""
        base = _MATCHED[self.op] & (emit != "indels") | (self.op == ord("D")) & (emit == "depth")
        per_read = np.bincount(self.read, np.where(base, self.len, 1), len(self.first)).astype(np.int64)
        number = (np.cumsum(per_read) - per_read) // SHOWN
        of_op = number[self.read]
        cuts = np.flatnonzero(np.diff(of_op)) + 1
        for run in np.split(np.arange(len(self.op)), cuts):
            if len(run):
                yield run

    def inserted(self, ops: np.ndarray) -> pa.Array:
        """The texts of insertions; null where the sequence is."""
        reads = self.read[ops]
        sizes = self.sizes[reads]
        low = np.minimum(self.at[ops], sizes)
        texts = runs(self.data, self.starts[reads] + low, np.minimum(self.at[ops] + self.len[ops], sizes) - low, pa.string())
        return pc.if_else(pa.array(self.known[reads]), texts, None) if len(ops) else texts

    def shown(self, run: np.ndarray, emit: str, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Reads, places and names of what a run of operations shows, and the texts of names from ABSENT + 1 on."""
        run = run[(self.len[run] > 0) & self.placed[self.read[run]]]
        op = self.op[run]
        based = run[_MATCHED[op] & (emit != "indels") | (op == ord("D")) & (emit == "depth")]
        many = self.len[based]
        rows = np.repeat(based, many)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        reads, places = self.read[rows], self.ref[rows] + nth
        if emit == "depth":
            return reads, places, np.full(len(rows), ABSENT), []
        if emit == "places":
            odd = run[(op == ord("I")) | (op == ord("D"))]
            reads, places = np.concatenate((reads, self.read[odd])), np.concatenate((places, self.ref[odd]))
            return reads, places, np.full(len(reads), ABSENT), []
        at = self.at[rows] + nth
        there = at < self.sizes[reads]
        names = np.zeros(len(rows), np.int64)
        names[there] = self.data[(self.starts[reads] + at)[there]]
        names[~self.known[reads]] = ABSENT
        if emit == "pileup":
            names = _SYMBOL[names]
        plus, minus = run[op == ord("I")], run[op == ord("D")] if emit in ("pileup", "indels") else run[:0]
        texts = self.inserted(plus)
        if emit in ("pileup", "indels"):
            gone = pc.binary_join_element_wise("-", pa.array(self.len[minus]).cast(pa.string()), "")
            texts = pa.concat_arrays([pc.binary_join_element_wise("+", texts, ""), gone])
        texts = texts.dictionary_encode()
        own = texts.indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) + ABSENT + 1
        odd = np.concatenate((plus, minus))
        reads, places, names = (np.concatenate(x) for x in ((reads, self.read[odd]), (places, self.ref[odd]), (names, own)))
        if ordered:  # as the operations follow one another
            order = np.argsort(np.concatenate((rows, odd)), kind="stable")
            reads, places, names = reads[order], places[order], names[order]
        return reads, places, names, texts.dictionary.to_pylist()


def _texts(names: np.ndarray, more: list[str]) -> pa.Array:
    words = ["", *map(chr, range(1, 128)), *["?"] * 128, None, *more]
    return pa.DictionaryArray.from_arrays(pa.array(names, pa.int32()), pa.array(words, pa.string())).cast(pa.string())


def walked(batch: pa.RecordBatch, emit: str, kernel, ordered: bool = False) -> Iterator[list[pa.Array]]:
    """What a kernel makes of each slice of a batch, whose last columns are pos0, cigar and seq."""
    if batch.num_rows:
        walk = Walk(*batch.columns[-3:])
        for part in walk.slices(emit):
            yield kernel(batch, *walk.shown(part, emit, ordered))


def _walks(df: DataFrame, emit: str, keys: list[str], kernel, more: list[StructField]) -> DataFrame:
    fields = [StructField("pos", LongType()), StructField("allele", StringType()), *more]
    return _kernel_rows(df, emit, keys, kernel, [df.schema[c] for c in keys] + fields, not more)


def _kernel_rows(df: DataFrame, emit: str, keys: list[str], kernel, fields: list[StructField], ordered: bool) -> DataFrame:
    """What a kernel makes of the alignments, as rows of these fields."""
    if emit not in EMITS + PARTS:
        raise ValueError(f"emit {emit}")
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in walked(batch, emit, kernel, ordered):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    seq = F.col("seq") if emit not in ("depth", "places") else F.lit("").alias("seq")
    return df.select(*keys, F.col("pos0").cast("long"), "cigar", seq).mapInArrow(run, StructType(fields))


def explode_cigar(df: DataFrame, emit: str) -> DataFrame:
    """df without cigar and seq, with a row (pos, allele) for all that an alignment shows; pos is 0-based.

    emit ``alleles``: every matched base, and inserted sequence at the next reference position. ``pileup``: matched
    bases by symbol, insertions as +SEQ at the next position, deletions as -LENGTH at their first base. ``depth``:
    every matched or deleted base, without a name. ``indels``: what pileup shows of insertions and deletions only.
    ``places``: what pileup shows, without a name, in any order. Skips and clips show nothing.
    """
    keys = [c for c in df.columns if c not in ("cigar", "seq", "pos0")]

    def kernel(batch: pa.RecordBatch, reads: np.ndarray, places: np.ndarray, names: np.ndarray, more: list[str]) -> list[pa.Array]:
        at = pa.array(reads)
        return [*(batch.column(i).take(at) for i in range(len(keys))), pa.array(places), _texts(names, more)]

    return _walks(df, emit, keys, kernel, [])


def _groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group of equal values, and the group of every row."""
    group, sample = np.zeros(rows, np.int64), np.zeros(min(rows, 1), np.int64)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, sample, group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_index=True, return_inverse=True)
    return sample, group


def _summed(group: np.ndarray, places: np.ndarray, names: np.ndarray, kinds: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups, places and names, each combination once and in order, with the sum of n, or how often each occurs."""
    low = int(places.min()) if len(places) else 0
    width = int(places.max()) - low + 1 if len(places) else 1
    where, found = places - low, None
    if width * kinds * (int(group.max(initial=0)) + 1) >= 1 << 62:
        found, where = np.unique(places, return_inverse=True)
        width = len(found)
    codes = (group * width + where) * kinds + names
    if n is None:
        codes, n = np.unique(codes, return_counts=True)
    else:
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else codes
        codes, n = codes[first], np.add.reduceat(n[order], first) if len(first) else n
    codes, names = np.divmod(codes, kinds)
    group, where = np.divmod(codes, width)
    return group, where + low if found is None else found[where], names, n


def batch_counts(keys: int):
    """The kernel that counts a slice by its first columns, place and name."""

    def kernel(batch: pa.RecordBatch, reads: np.ndarray, places: np.ndarray, names: np.ndarray, more: list[str]) -> list[pa.Array]:
        sample, group = _groups(batch.columns[:keys], batch.num_rows)
        groups, places, names, n = _summed(group[reads], places, names, ABSENT + 1 + len(more))
        at = pa.array(sample[groups])
        return [*(batch.column(i).take(at) for i in range(keys)), pa.array(places), _texts(names, more), pa.array(n.astype(np.int64))]

    return kernel


def packed(keys: list[pa.Array], group: np.ndarray, places: np.ndarray, names: np.ndarray, n: np.ndarray, more: pa.Array) -> list[pa.Array]:
    """Counts that are in order of group and place as a row for each stretch of a group: keys, bin, entries, texts.

    keys: of each group. more: the texts of names from ABSENT + 1 on.
    """
    bins = places // BIN
    first = np.flatnonzero(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(bins) != 0)))) if len(places) else np.empty(0, np.int64)
    own = np.flatnonzero(names > ABSENT)
    data, starts, sizes = letters(more.take(pa.array(names[own] - ABSENT - 1)))
    short = sizes < 2  # a text of one letter or none is that base
    names = names.copy()
    names[own[sizes == 0]], names[own[sizes == 1]] = 0, data[starts[sizes == 1]]
    own, starts, sizes = own[~short], starts[~short], sizes[~short]
    entries = np.empty(len(places), ENTRY)
    entries["at"], entries["name"], entries["n"] = places - bins * BIN, names, n
    entries["name"][own] = ABSENT + 1 + sizes
    length = np.zeros(len(places) + 1, np.int64)
    length[own + 1] = sizes
    written = np.cumsum(length)[np.append(first, len(places))]
    return [
        *(k.take(pa.array(group[first])) for k in keys), pa.array(bins[first]),
        cut_up(entries.view(np.uint8), np.diff(np.append(first, len(places))) * ENTRY.itemsize, pa.binary()),
        cut_up(np.ascontiguousarray(data[gather(starts, sizes)]), np.diff(written), pa.binary()),
    ]


def _unpacked(rows: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, place, name and number of all entries, and the texts of names from ABSENT + 1 on, each once."""
    bins, data, texts = (rows.column(keys + i) for i in range(3))
    (data, starts, sizes), (letters, begin, _) = bytes_of(data), bytes_of(texts)
    entries = data[starts[0] : starts[-1] + sizes[-1]].view(ENTRY)
    row = np.repeat(np.arange(rows.num_rows), sizes // ENTRY.itemsize)
    names = entries["name"].astype(np.int64)
    own = np.flatnonzero(names > ABSENT)
    more = cut_up(letters[begin[0] :], names[own] - ABSENT - 1, pa.string()).dictionary_encode()
    names[own] = ABSENT + 1 + more.indices.to_numpy(zero_copy_only=False)
    return row, bins.to_numpy()[row] * BIN + entries["at"], names, entries["n"], more.dictionary


def _merged(batches: Iterable[pa.RecordBatch], keys: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The counts of packed rows that come in order of their keys and bins; of a stretch no more is held than its sums."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays([*batch.columns[: keys + 1], *(c.cast(pa.binary()) for c in batch.columns[keys + 1 :])], names=batch.schema.names)
        most = np.cumsum(bytes_of(batch.column(keys + 1))[2]) // (SHOWN * ENTRY.itemsize)
        cuts = [0, *(np.flatnonzero(np.diff(most)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(low, high - low)
            if held is not None:
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([h, c]) for h, c in zip(held, part.columns, strict=True)], names=part.schema.names)
            sample, group = _groups(part.columns[:keys], part.num_rows)
            row, places, shown, n, more = _unpacked(part, keys)
            groups, places, shown, n = _summed(group[row], places, shown, ABSENT + 1 + len(more), n)
            last = (groups == group[-1]) & (places // BIN == part.column(keys)[-1].as_py())
            own = [c.take(pa.array(sample)) for c in part.columns[:keys]]
            held = packed(own, groups[last], places[last], shown[last], n[last], more)
            yield _counts(own, groups[~last], places[~last], shown[~last], n[~last], more, names)
    if held is not None:
        row, places, shown, n, more = _unpacked(pa.RecordBatch.from_arrays(held, names=[str(i) for i in range(len(held))]), keys)
        yield _counts(held[:keys], row, places, shown, n, more, names)


def _counts(keys: list[pa.Array], group: np.ndarray, places: np.ndarray, shown: np.ndarray, n: np.ndarray, more: pa.Array, names: list[str]) -> pa.RecordBatch:
    at = pa.array(group)
    return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array(places), _texts(shown, more.to_pylist()), pa.array(np.ascontiguousarray(n))], names=names)


def counted(df: DataFrame, emit: str, by: list[str], among: DataFrame | None = None) -> DataFrame:
    """by, pos, allele, n: how often alignments show each thing, summed in each batch and then over all.

    What a batch shows of a stretch of BIN places is one row of the shuffle, and stretches are summed as they come sorted.
    among (by, pos): other places are left out before the sum, which needs no shuffle of its own then.
    """
    if among is not None:
        parts = _walks(df, emit, by, batch_counts(len(by)), [StructField("n", LongType())])
        parts = parts.join(among.select(*by, "pos").distinct().hint("shuffle_hash"), [*by, "pos"], "left_semi")
        return parts.groupBy(*by, "pos", "allele").agg(F.sum("n").alias("n"))
    keys = [df.schema[c] for c in by]

    def kernel(batch: pa.RecordBatch, reads: np.ndarray, places: np.ndarray, names: np.ndarray, more: list[str]) -> list[pa.Array]:
        sample, group = _groups(batch.columns[: len(by)], batch.num_rows)
        sums = _summed(group[reads], places, names, ABSENT + 1 + len(more))
        return packed([c.take(pa.array(sample)) for c in batch.columns[: len(by)]], *sums, pa.array(more, pa.string()))

    bins = [StructField("_bin", LongType()), StructField("_entries", BinaryType()), StructField("_texts", BinaryType())]
    parts = _kernel_rows(df, emit, by, kernel, keys + bins, False)
    out = [*keys, StructField("pos", LongType()), StructField("allele", StringType()), StructField("n", LongType())]
    names = [f.name for f in out]
    return parts.repartition(*by, "_bin").sortWithinPartitions(*by, "_bin").mapInArrow(lambda batches: _merged(batches, len(by), names), StructType(out))


def properly_paired(df: DataFrame) -> DataFrame:
    """Mapped, properly paired reads that are no duplicates."""
    flag = F.col("flag")
    return df.where((flag.bitwiseAND(F.lit(UNMAPPED | DUPLICATE)) == 0) & (flag.bitwiseAND(F.lit(PROPER_PAIR)) != 0))


def depth(df: DataFrame) -> DataFrame:
    """chrom, pos, depth: properly paired reads that match or delete each position."""
    return counted(properly_paired(df), "depth", ["chrom"]).select("chrom", "pos", F.col("n").alias("depth"))
