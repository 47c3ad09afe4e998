"""BGZF files of any size in splits: whole blocks by Spark's own text reader and writer, records across blocks and splits.

Every block begins with a fixed header, of which six bytes are ASCII and serve as the separator of "lines": Spark cuts
a file into splits and hands each the blocks that begin in it, from any file system and one block at a time. What lies
between two separators holds the size of the block, so a separator that occurs by chance inside a block is told and
its pieces are joined.

Records cross blocks and splits. In the first split of a file the place of the first record is known. In others it is
searched: a place from which plausible records follow one another. What a split has before that place and after its
last whole record is put together with its neighbours' (``fragments``, ``joined``), and these must again be whole
records, which proves by induction that every search was right; if one is not, an error is raised. A split in which no
place is found goes into such a string as a whole. An empty file has no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The header of a block up to its size, and the empty block that ends a file.
HEADER = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
END = HEADER + b"\x1b\0\x03\0" + b"\0" * 8
#: The ASCII part of the header, which separates blocks, and how much of the header comes before it.
SEPARATOR, BEFORE = "\x06\0BC\x02\0", 10
#: Uncompressed bytes of a block that is written; bytes that are searched for a first record; records that confirm one.
BLOCK, SEARCHED, CONFIRMED = 0xFF00, 1 << 24, 16


def compressed(data: bytes, level: int = 6) -> bytes:
    """Data as BGZF blocks, without the empty one that ends a file."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        if len(body) > 0xFFFF - 25:  # what cannot be compressed is stored
            packer = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
        out.append(HEADER + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def write_blocks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A BGZF file for each partition of chunks (one binary column, in order), written and committed by Spark.

    Every row becomes blocks and an empty block, whose last bytes are ASCII and serve as the end of a "line".
    """
    name = chunks.columns[0]
    tail = END[16:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compressed(x) + END[:16] for x in batch.column(0).to_pylist() if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    blocks = chunks.select(name).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    blocks.write.mode(mode).option("lineSep", tail.decode()).text(path)


def raw_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start (of the split), value: what follows each separator, in the order of the file within a split."""
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


@dataclass
class Split:
    """The uncompressed bytes of one split, block by block."""

    file: str
    start: int
    blocks: Iterator[bytes]


def splits(batches: Iterable[pa.RecordBatch]) -> Iterator[Split]:
    """The splits of a partition of raw_blocks."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        file, start = ahead[:2]

        def own(file: str = file, start: int = start) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == (file, start):
                value = ahead[2]
                ahead = next(rows, None)
                yield value

        values = own()
        yield Split(file, start, inflated(values, file, start))
        for _ in values:  # what the caller has not read
            pass


def inflated(values: Iterator[bytes], file: str, start: int) -> Iterator[bytes]:
    """The contents of the blocks of one split."""
    held, first = b"", start == 0
    for value in values:
        if first:  # what stands before the first separator of a file
            first = False
            if len(value) != BEFORE or value[:4] != HEADER[:4]:
                raise ValueError(f"{file} is no BGZF file")
            continue
        held = held + SEPARATOR.encode() + value if held else value
        size = struct.unpack_from("<H", held)[0] - 15 if len(held) > 1 else 1 << 17  # with the two bytes of the size
        if len(held) < size:
            continue  # the separator was part of the data
        if held[size:] and (len(held) != size + BEFORE or held[size : size + 4] != HEADER[:4]):
            raise ValueError(f"{file} has a broken block, or a split begins within one: read it with other splits")
        data = zlib.decompress(held[2 : size - 8], -15)
        if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", held, size - 8):
            raise ValueError(f"{file} has a broken block")
        held = b""
        if data:
            yield data
    if held:
        raise ValueError(f"{file}: a BGZF block is cut off")


@dataclass(frozen=True)
class Format:
    """How records lie in the uncompressed bytes. All functions take (bytes, offset)."""

    header: Callable[[bytes], int | None]  # where the header of a file ends; None: more bytes are needed
    size: Callable[[bytes, int], int | None]  # bytes of the record that begins there; None: more bytes are needed
    plausible: Callable[[bytes, int], bool | None]  # whether a record may begin there; None: more bytes are needed


class Stream:
    """The bytes of one split from its first record on."""

    def __init__(self, split: Split, form: Format):
        self.form, self.split, self.data, self.at = form, split, bytearray(), 0
        self.header = self.head = b""
        self.found = True  # whether a record begins in this split
        if split.start == 0:
            while (end := form.header(self.data)) is None:
                if not self.more():
                    raise ValueError(f"{split.file} ends within its header")
            self.header, self.at = bytes(self.data[:end]), end
        else:
            self.found = self.search()

    def more(self) -> bool:
        block = next(self.split.blocks, None)
        self.data += block or b""
        return block is not None

    def search(self) -> bool:
        """Move to the first place from which plausible records follow one another; without any, all is head."""
        for at in range(SEARCHED):
            while len(self.data) - at < 1 << 10 and self.more():
                pass
            if at >= len(self.data):
                break
            if self.follows(at):
                self.head, self.at = bytes(self.data[:at]), at
                return True
        while self.more():
            pass
        self.head, self.at = bytes(self.data), len(self.data)
        return False

    def follows(self, at: int) -> bool:
        """Whether records follow one another from a place on: CONFIRMED of them, or at least two up to the end of the split."""
        for number in range(CONFIRMED):
            while (good := self.form.plausible(self.data, at)) is None and self.more():
                pass
            if not good:
                return good is None and number > 1
            size = self.form.size(self.data, at)
            while at + size > len(self.data) and self.more():
                pass
            if at + size > len(self.data):
                return number > 1
            at += size
        return True

    def records(self) -> Iterator[bytes]:
        """The whole records; what is left of the last one is the tail."""
        while True:
            size = self.form.size(self.data, self.at)
            if size is None or self.at + size > len(self.data):
                if self.at > 1 << 20:
                    del self.data[: self.at]
                    self.at = 0
                if not self.more():
                    return
                continue
            yield bytes(self.data[self.at : self.at + size])
            self.at += size

    @property
    def tail(self) -> bytes:
        return bytes(self.data[self.at :])


FRAGMENTS = "file string, start long, header binary, head binary, tail binary, found boolean, records long"


def fragments(raw: DataFrame, form: Format) -> DataFrame:
    """One row for each split: its header, the bytes before its first record and after its last, and how many it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split in splits(batches):
            stream = Stream(split, form)
            n = sum(1 for _ in stream.records()) if stream.found else 0
            row = [split.file, split.start, stream.header or None, stream.head, stream.tail if stream.found else b"", stream.found, n]
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int64())
            names = [c.split()[0] for c in FRAGMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return raw.mapInArrow(run, FRAGMENTS)


def joined(pieces: DataFrame) -> DataFrame:
    """file, start, data: the records that cross splits, each under the split in which it begins.

    A tail and the heads after it are one string up to the next split in which a record begins.
    """
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)  # a small row for each split
    opened = F.max(F.when(F.col("found"), F.col("start")))
    piece = lambda opened, part, data: F.struct(opened.alias("opened"), F.lit(part).alias("part"), F.col(data).alias("data"))
    ends = F.array(piece(F.col("before"), 1, "head"), piece(F.when(F.col("found"), F.col("start")), 0, "tail"))
    own = pieces.withColumn("before", opened.over(before)).select("file", "start", F.explode(ends).alias("e")).where(F.col("e.opened").isNotNull() & (F.length("e.data") > 0))
    parts = F.array_sort(F.collect_list(F.struct("e.part", "start", "e.data")))
    strung = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["data"]))
    return own.groupBy("file", F.col("e.opened").alias("start")).agg(strung.alias("data"))


def whole_records(data: bytes, form: Format, file: str) -> Iterator[bytes]:
    """Records of a string that must hold nothing else."""
    at = 0
    while at < len(data):
        size = form.size(data, at)
        if size is None or at + size > len(data):
            raise ValueError(f"{file} ends within a record, or a split was cut at a wrong place: read it with other splits")
        yield data[at : at + size]
        at += size
