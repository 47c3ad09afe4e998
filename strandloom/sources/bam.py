"""BAM and SAM."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.cigar import bytes_of, gather, letters, operations, parse_cigar, runs
from strandloom.sources import bgzf
from strandloom.sources.shared import cut

#: Fixed values of the format: operations, letters of bases, the fields that every record begins with.
OPERATIONS, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
FIELDS = np.dtype([
    ("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"),
    ("bases", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("template", "<i4"),
])
#: Records of one batch, and bytes of it, about.
BATCH, BATCH_BYTES = 4096, 1 << 24
COLUMNS = {
    "file": "string", "read_no": "long", "qname": "string", "flag": "int", "chrom": "string", "pos0": "long", "mapq": "int",
    "cigar": "array<struct<op:string,len:int>>", "seq": "string", "qual": "binary", "rg_sm": "string",
}
_CIGAR = pa.struct([("op", pa.string()), ("len", pa.int32())])
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), COLUMNS["cigar"]: pa.list_(_CIGAR)}


def header_end(data: bytes) -> int | None:
    if len(data) >= 4 and bytes(data[:4]) != b"BAM\1":
        raise ValueError("this is no BAM file")
    if len(data) < 8 or len(data) < (at := 12 + struct.unpack_from("<i", data, 4)[0]):
        return None
    for _ in range(struct.unpack_from("<i", data, at - 4)[0]):
        if len(data) < at + 4:
            return None
        at += 8 + struct.unpack_from("<i", data, at)[0]
    return at if len(data) >= at else None


def record_size(data: bytes, at: int) -> int | None:
    return 4 + struct.unpack_from("<i", data, at)[0] if len(data) - at >= 4 else None


def plausible(data: bytes, at: int) -> bool | None:
    """Whether the fields at a place are those of a record: all within their ranges, the name ended, the sizes in agreement."""
    if len(data) - at < FIELDS.itemsize:
        return None
    size, ref, pos, name, _, _, ops, flag, bases, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < 1 << 24 and -1 <= next_ref < 1 << 24 and pos >= -1 and next_pos >= -1 and name and flag < 1 << 12 and bases >= 0):
        return False
    if not 32 + name + 4 * ops + (bases + 1) // 2 + bases <= size < 1 << 30:
        return False
    at += FIELDS.itemsize
    if len(data) < at + name:
        return None
    return data[at + name - 1] == 0 and all(33 <= c < 127 for c in data[at : at + name - 1])


BAM = bgzf.Format(header_end, record_size, plausible)


def sample_of(header: str) -> str:
    """The sample of the first read group, or an empty text."""
    for line in header.split("\n"):
        if line.startswith("@RG"):
            return next((x[3:] for x in line.rstrip("\r").split("\t") if x.startswith("SM:")), "")
    return ""


def references(header: bytes) -> tuple[str, list[str]]:
    """The sample and the names of the reference sequences."""
    at = 8 + struct.unpack_from("<i", header, 4)[0]
    sample, names = sample_of(header[8:at].rstrip(b"\0").decode()), []
    for _ in range(struct.unpack_from("<i", header, at)[0]):
        n = struct.unpack_from("<i", header, at + 4)[0]
        names.append(header[at + 8 : at + 7 + n].decode())
        at += 8 + n
    return sample, names


#: The letters of a byte of bases, and the numbers of letters and operations; 255 is no operation.
_NIBBLES = np.array([[ord(LETTERS[i >> 4]), ord(LETTERS[i & 15])] for i in range(256)], np.uint8)
_DIGITS = np.array([LETTERS.index(c) if (c := chr(i).upper()) in LETTERS else 15 for i in range(256)], np.uint8)
_CODES = np.array([OPERATIONS.index(chr(i)) if chr(i) in OPERATIONS else 255 for i in range(256)], np.int64)


def decode(records: list[bytes], wanted: set[str]) -> dict[str, pa.Array]:
    """The wanted columns of records, whole columns at a time; of the others nothing is decoded."""
    sizes = np.array([len(r) for r in records], np.int64)
    data = np.frombuffer(b"".join(records), np.uint8)
    starts = np.cumsum(sizes) - sizes
    fixed = data[starts[:, None] + np.arange(FIELDS.itemsize)].reshape(-1).view(FIELDS)
    name, ops, bases = (fixed[c].astype(np.int64) for c in ("name", "ops", "bases"))
    at_ops = starts + FIELDS.itemsize + name
    at_seq = at_ops + 4 * ops
    packed = (bases + 1) // 2
    out = {"flag": pa.array(fixed["flag"].astype(np.int32)), "pos0": pa.array(fixed["pos"].astype(np.int64)), "mapq": pa.array(fixed["mapq"].astype(np.int32)), "ref": pa.array(fixed["ref"].astype(np.int32))}
    if "qname" in wanted:
        out["qname"] = runs(data, starts + FIELDS.itemsize, name - 1, pa.string())
    if "cigar" in wanted:
        codes = np.ascontiguousarray(data[gather(at_ops, 4 * ops)]).view("<u4")
        kinds = pa.DictionaryArray.from_arrays(pa.array((codes & 15).astype(np.int32)), pa.array([*OPERATIONS, *"???????"])).cast(pa.string())
        each = pa.StructArray.from_arrays([kinds, pa.array((codes >> 4).astype(np.int32))], fields=list(_CIGAR))
        out["cigar"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ops))), pa.int32()), each)
    if "seq" in wanted:
        letters = _NIBBLES[data[gather(at_seq, packed)]].reshape(-1)
        out["seq"] = runs(letters, 2 * (np.cumsum(packed) - packed), bases, pa.string())
    if "qual" in wanted:
        out["qual"] = runs(data, at_seq + packed, bases, pa.binary())
    return out


def read_bam(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Alignments of BAM files of any size, in many tasks a file; rg_sm is the sample of the first read group, empty if there is none.

    columns: which of COLUMNS are wanted; of the others nothing is decoded, and without read_no, the number of a record
    in its file, no record is numbered. What crosses two splits is found by one more pass over the input, which keeps a
    small row for each split. What is no BAM file, or ends within a record, raises an error when rows are read.
    """
    wanted = list(COLUMNS) if columns is None else list(columns)
    if unknown := set(wanted) - set(COLUMNS):
        raise ValueError(f"no columns {sorted(unknown)}")
    raw = bgzf.raw_blocks(spark, path)
    pieces = cut(bgzf.fragments(raw, BAM), "fragments")
    strung = bgzf.joined(pieces).join(pieces.select("file", "start", "records"), ["file", "start"])
    made = [c for c in wanted if c not in ("file", "read_no", "chrom", "rg_sm")]
    kinds = {"file": "string", "start": "long", "nth": "long", "ref": "int"} | {c: COLUMNS[c] for c in made}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())

    def batches_of(records: Iterator[bytes], file: str, start: int, nth: int) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            n = len(held)
            own = {"file": pa.array([file] * n), "start": pa.array(np.full(n, start)), "nth": pa.array(np.arange(nth, nth + n))} | decode(held, set(made))
            return pa.RecordBatch.from_arrays([own[c].cast(_ARROW[k]) for c, k in kinds.items()], names=list(kinds))

        for record in records:
            held.append(record)
            size += len(record)
            if len(held) == BATCH or size > BATCH_BYTES:
                yield out()
                nth, held, size = nth + len(held), [], 0
        if held:
            yield out()

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split in bgzf.splits(batches):
            stream = bgzf.Stream(split, BAM)
            if stream.found:
                yield from batches_of(stream.records(), split.file, split.start, 0)

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, data, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from batches_of(bgzf.whole_records(data, BAM, file), file, start, before)

    rows = raw.mapInArrow(inside, schema).unionByName(strung.select("file", "start", "data", "records").mapInArrow(across, schema))
    if "read_no" in wanted:
        rows = rows.join(_before(pieces, strung), ["file", "start"]).withColumn("read_no", F.col("nth") + F.col("before"))
    if "chrom" in wanted or "rg_sm" in wanted:
        rows = rows.join(_references(pieces), ["file", "ref"])
    return rows.select(*wanted)


def _before(pieces: DataFrame, strung: DataFrame) -> DataFrame:
    """file, start, before: how many records of the file come before those of each split."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [sum(1 for _ in bgzf.whole_records(d, BAM, f)) for f, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, pa.int64())], names=["file", "start", "more"])

    crossing = strung.select("file", "start", "data").mapInArrow(count, "file string, start long, more long")
    own = pieces.select("file", "start", "records").join(crossing, ["file", "start"], "left")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    total = F.sum(F.col("records") + F.coalesce("more", F.lit(0))).over(earlier)
    return own.select("file", "start", F.coalesce(total, F.lit(0)).alias("before"))


def _references(pieces: DataFrame) -> DataFrame:
    """file, ref, chrom, rg_sm: the names of the reference sequences of each file, and null for reads without one."""

    def names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sample, every = references(header)
                n = len(every) + 1
                columns = [[file] * n, list(range(-1, n - 1)), [None, *every], [sample] * n]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["file", "ref", "chrom", "rg_sm"])

    headers = pieces.where(F.col("header").isNotNull()).select("file", "header")
    return headers.mapInArrow(names, "file string, ref int, chrom string, rg_sm string")


def encode(batch: pa.RecordBatch, number: dict[str, int]) -> Iterator[bytes]:
    """The records of a batch (qname, flag, chrom, pos0, mapq, cigar, seq, qual), whole columns at a time, about BATCH_BYTES at once.

    number: that of each reference sequence. What a field cannot hold raises ValueError.
    """
    size = sum(c.nbytes for c in batch.columns)
    if size > BATCH_BYTES and batch.num_rows > 1:
        half = batch.num_rows // 2
        yield from encode(batch.slice(0, half), number)
        yield from encode(batch.slice(half), number)
        return
    qname, flag, chrom, pos, mapq, cigar, seq, qual = batch.columns
    n = batch.num_rows
    qname = pc.if_else(pc.equal(pc.binary_length(qname).fill_null(0), 0), "*", qname)
    names, name_at, name_size = bytes_of(qname.cast(pa.binary()))
    bases, base_at, base_size = letters(seq)
    marks, mark_at, mark_size = bytes_of(qual.cast(pa.binary()).fill_null(b""))
    marked = qual.is_valid().to_numpy(zero_copy_only=False)
    ops, op, length = operations(cigar)
    code = np.where(op < 256, _CODES[op & 255], 255)
    if (code > 15).any():
        raise ValueError(f"CIGARs have operations other than {OPERATIONS}")
    refs = chrom.dictionary_encode()
    if unknown := [c for c in refs.dictionary.to_pylist() if c not in number]:
        raise ValueError(f"reference sequences {unknown} are no contigs")
    ref = np.array([*(number[c] for c in refs.dictionary.to_pylist()), -1], np.int64)[refs.indices.fill_null(len(refs.dictionary)).to_numpy(zero_copy_only=False)]
    packed, qualities = (base_size + 1) // 2, np.where(marked, mark_size, base_size)
    sizes = FIELDS.itemsize + name_size + 1 + 4 * ops + packed + qualities
    values = {
        "size": sizes - 4, "ref": ref, "pos": ints(pos.fill_null(-1), "pos0"), "name": name_size + 1, "mapq": ints(mapq, "mapq"), "ops": ops, "flag": ints(flag, "flag"),
        "bases": base_size, "next_ref": np.full(n, -1), "next_pos": np.full(n, -1),
    }
    fixed = np.zeros(n, FIELDS)
    for field, value in values.items():
        fits = np.iinfo(FIELDS[field])
        if n and not (fits.min <= value.min() and value.max() <= fits.max):
            raise ValueError(f"a record cannot hold {field} from {value.min()} to {value.max()}")
        fixed[field] = value
    if len(length) and not 0 <= length.min() <= length.max() < 1 << 28:
        raise ValueError(f"a record cannot hold operations of length {length.min()} to {length.max()}")
    out = np.full(int(sizes.sum()), 255, np.uint8)  # absent qualities are 255
    at = np.cumsum(sizes) - sizes
    out[at[:, None] + np.arange(FIELDS.itemsize)] = fixed.view(np.uint8).reshape(n, FIELDS.itemsize)
    at = at + FIELDS.itemsize
    out[gather(at, name_size)] = names[gather(name_at, name_size)]
    out[at + name_size] = 0
    at = at + name_size + 1
    out[gather(at, 4 * ops)] = (length << 4 | code).astype("<u4").view(np.uint8)
    at = at + 4 * ops
    digits = np.zeros(2 * int(packed.sum()), np.uint8)
    digits[gather(2 * (np.cumsum(packed) - packed), base_size)] = _DIGITS[bases[gather(base_at, base_size)]]
    out[gather(at, packed)] = digits[::2] << 4 | digits[1::2]
    at = (at + packed)[marked]
    out[gather(at, mark_size[marked])] = marks[gather(mark_at[marked], mark_size[marked])]
    yield out.tobytes()


def ints(values: pa.Array, name: str) -> np.ndarray:
    if values.null_count:
        raise ValueError(f"{name} is null")
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def write_bam(alignments: DataFrame, path: str, contigs: dict[str, int], sample: str = "", mode: str = "errorifexists") -> None:
    """A BAM file for each partition of alignments (qname, flag, chrom, pos0, mapq, cigar, seq, qual), in order.

    contigs: name -> length of the reference sequences. A null chrom or place is written as none, a null qual as absent.
    cigar: arrays or texts.
    """
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs.items()) + (f"@RG\tID:1\tSM:{sample}\n" if sample else "")
    listed = b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs.items())
    header = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + listed
    number = {c: i for i, c in enumerate(contigs)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = header
        for batch in batches:
            for low in range(0, max(batch.num_rows, 1), BATCH):
                for data in encode(batch.slice(low, BATCH), number):
                    yield pa.RecordBatch.from_arrays([pa.array([start + data], pa.binary())], names=["data"])
                    start = b""

    fields = ["qname", "flag", "chrom", "pos0", "mapq", "cigar", "seq"]
    qual = F.col("qual").cast("binary") if "qual" in alignments.columns else F.lit(None).cast("binary").alias("qual")
    bgzf.write_blocks(alignments.select(*fields, qual).mapInArrow(run, "data binary"), path, mode)


def with_sample(alignments: DataFrame) -> DataFrame:
    """alignments with sample: that of the read group, else the name of the file."""
    return alignments.withColumn("sample", F.coalesce(F.nullif("rg_sm", F.lit("")), F.substring_index("file", "/", -1)))


def parse_sam(lines: DataFrame, value: str = "value", cigars: bool = True) -> DataFrame:
    """qname, flag, chrom, pos0, mapq, cigar, seq, qual of SAM lines; header lines are left out.

    Without cigars, these stay texts, which the walks of ``operators.cigar`` take as they are. The fields of a line come
    out of a generator: Spark would else push every later filter of them below what the lines are made from, where
    each splits all lines once more, in the tasks of a table that may be one file.
    """
    f = F.explode_outer(F.array(F.split(value, "\t")))
    part = lambda i: F.col("f")[i]
    return lines.select(f.alias("f")).where(~part(0).startswith("@")).select(
        part(0).alias("qname"), part(1).cast("int").alias("flag"), F.nullif(part(2), F.lit("*")).alias("chrom"), (part(3).cast("bigint") - 1).alias("pos0"), part(4).cast("int").alias("mapq"), (parse_cigar(part(5)) if cigars else part(5)).alias("cigar"), part(9).alias("seq"), part(10).alias("qual")
    )
