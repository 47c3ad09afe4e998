"""BCF: the rows of ``vcf.parse_vcf`` from the binary form, read in splits of BGZF blocks and written in them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandloom.sources import bgzf
from strandloom.sources.shared import cut

#: Fixed values of the format: its mark, types of values, and what stands for a missing value and for the end of a vector.
MAGIC = b"BCF\2\2"
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
KINDS = {INT8: np.dtype("i1"), INT16: np.dtype("<i2"), INT32: np.dtype("<i4"), FLOAT: np.dtype("<u4"), CHAR: np.dtype("S1")}
MISSING = {INT8: -0x80, INT16: -0x8000, INT32: -0x80000000, FLOAT: 0x7F800001}
END = {kind: value + 1 for kind, value in MISSING.items()}
FIXED = struct.Struct("<IIiiifII")
#: Records of one batch.
BATCH = 2048

ROWS = (
    "chrom string, pos long, id string, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>, "
    "format array<string>, samples array<struct<name:string,fields:map<string,string>>>"
)
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([
    ("chrom", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("qual", pa.float32()),
    ("filters", pa.list_(pa.string())), ("info", _MAP), ("format", pa.list_(pa.string())),
    ("samples", pa.list_(pa.struct([("name", pa.string()), ("fields", _MAP)]))),
])


@dataclass
class Header:
    """The dictionaries of a header: names by number, and the types of the fields."""

    strings: dict[int, str] = field(default_factory=lambda: {0: "PASS"})
    contigs: dict[int, str] = field(default_factory=dict)
    types: dict[tuple[str, str], str] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)


def parse_header(lines: Iterable[str]) -> Header:
    """Numbers are those of IDX, else the order of the lines; filters, info and format fields share theirs by name."""
    out = Header()
    for line in lines:
        if line.startswith("#CHROM"):
            out.samples = line.split("\t")[9:]
        found = re.match(r"##(contig|FILTER|INFO|FORMAT)=<", line)
        name = found and re.search(r"[<,]ID=([^,>]*)", line)
        if not name:
            continue
        kind, name = found[1], name[1]
        names = out.contigs if kind == "contig" else out.strings
        number = re.search(r",IDX=(\d+)", line)
        if number or name not in names.values():
            names[int(number[1]) if number else max(names, default=-1) + 1] = name
        if kind in ("INFO", "FORMAT"):
            out.types[kind, name] = (re.search(r"[<,]Type=([^,>]*)", line) or ("", "String"))[1]
    return out


def header_end(data: bytes) -> int | None:
    if len(data) >= 5 and bytes(data[:5]) != MAGIC:
        raise ValueError("this is no BCF file of version 2.2")
    if len(data) < 9:
        return None
    end = 9 + struct.unpack_from("<I", data, 5)[0]
    return end if len(data) >= end else None


def record_size(data: bytes, at: int) -> int | None:
    return 8 + sum(struct.unpack_from("<II", data, at)) if len(data) - at >= 8 else None


def descriptor(data: bytes, at: int) -> tuple[int, int, int]:
    """Number of values, their type, and where they begin."""
    n, kind = data[at] >> 4, data[at] & 15
    if n < 15:
        return n, kind, at + 1
    size = KINDS[data[at + 1] & 15]
    return int(np.frombuffer(data, size, 1, at + 2)[0]), kind, at + 2 + size.itemsize


def plausible(data: bytes, at: int) -> bool | None:
    """Whether the fields at a place are those of a record: within their ranges, with an id and alleles that are texts."""
    if len(data) - at < FIXED.size:
        return None
    shared, own, chrom, pos, span, _, alleles, samples = FIXED.unpack_from(data, at)
    if not (0 <= chrom < 1 << 24 and pos >= -1 and span >= 0 and FIXED.size - 8 < shared < 1 << 28 and own < 1 << 30 and (own > 0) == (samples >> 24 > 0)):
        return False
    end, at = at + 8 + shared, at + FIXED.size
    for _ in range(1 + (alleles >> 16)):
        if len(data) < at + 16 and len(data) < end:
            return None
        try:
            n, kind, at = descriptor(data, at)
        except (KeyError, ValueError, IndexError):
            return False
        if kind not in (0, CHAR) or n < 0 or at + n > end:
            return False
        if len(data) < at + n:
            return None
        if not all(33 <= c < 127 for c in data[at : at + n]):
            return False
        at += n
    return at < end


BCF = bgzf.Format(header_end, record_size, plausible)


def texts(data: bytes, at: int, kind: int, n: int, rows: int = 1) -> tuple[list[str | None], int]:
    """rows vectors of n values as VCF writes them, null for a vector that is not there, and where they end."""
    if not n or not kind:
        return [None] * rows, at
    size = KINDS[kind]
    end = at + rows * n * size.itemsize
    if kind == CHAR:
        return [data[i : i + n].rstrip(b"\0").decode() or None for i in range(at, end, n)], end
    values = np.frombuffer(data, size, rows * n, at).reshape(rows, n)
    written = values.view("<f4") if kind == FLOAT else values
    out = []
    for codes, row in zip(values.tolist(), written.tolist(), strict=True):
        kept = [("." if c == MISSING[kind] else f"{v:g}") for c, v in zip(codes, row, strict=True) if c != END[kind]] if kind == FLOAT else [
            "." if c == MISSING[kind] else str(c) for c in codes if c != END[kind]]
        out.append(",".join(kept) or None)
    return out, end


def genotype_texts(data: bytes, at: int, kind: int, n: int, rows: int) -> tuple[list[str | None], int]:
    size = KINDS[kind or INT8]
    out = []
    for codes in np.frombuffer(data, size, rows * n, at).reshape(rows, n).tolist():
        parts = ["|/"[not c & 1] + (str((c >> 1) - 1) if c >> 1 else ".") for c in codes if kind in END and c not in (END[kind], MISSING[kind])]
        out.append("".join(parts)[1:] or None)
    return out, at + rows * n * size.itemsize


def decode(data: bytes, header: Header) -> tuple:
    """One record as a row."""
    shared, _, chrom, pos, _, _, alleles, samples = FIXED.unpack_from(data)
    no_qual = struct.unpack_from("<I", data, 20)[0] == MISSING[FLOAT]
    at, names = FIXED.size, []
    for _ in range(1 + (alleles >> 16)):
        n, _, at = descriptor(data, at)
        names.append(data[at : at + n].decode())
        at += n
    n, kind, at = descriptor(data, at)
    filters = np.frombuffer(data, KINDS[kind or INT8], n, at).tolist()
    at += n * KINDS[kind or INT8].itemsize
    info = {}

    def key(at: int) -> tuple[str, int]:
        n, kind, at = descriptor(data, at)
        return header.strings[int(np.frombuffer(data, KINDS[kind], n, at)[0])], at + n * KINDS[kind].itemsize

    for _ in range(alleles & 0xFFFF):
        name, at = key(at)
        n, kind, at = descriptor(data, at)
        flag = not n or header.types.get(("INFO", name)) == "Flag"
        (value,), at = texts(data, at, kind, n)
        info[name] = None if flag else value if value is not None else "."
    at, many, fields = 8 + shared, samples & 0xFFFFFF, {}
    for _ in range(samples >> 24):
        name, at = key(at)
        n, kind, at = descriptor(data, at)
        values, at = (genotype_texts if name == "GT" and kind != CHAR else texts)(data, at, kind, n, many)
        fields[name] = [None if v == "." else v for v in values]
    called = [{"name": s, "fields": [(k, v[i]) for k, v in fields.items()]} for i, s in enumerate(header.samples)]
    known = lambda s: None if s in ("", ".") else s
    return (
        header.contigs[chrom], pos + 1, known(names[0]), names[1] if len(names) > 1 else None, names[2:], None if no_qual else struct.unpack_from("<f", data, 20)[0],
        [header.strings[f] for f in filters], list(info.items()), list(fields), called,
    )


def read_bcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The variants of BCF files of any size as ``vcf.parse_vcf`` has them, in many tasks a file.

    Numbers become texts, reals with six digits. The files share one header, which the tasks get; of files that do not,
    ValueError: read each and put them together with ``vcf.merge_vcfs``. What crosses two splits is found by one more
    pass. What is no BCF 2.2, or ends within a record, raises an error when rows are read. No files, no rows.
    """
    raw = bgzf.raw_blocks(spark, path)
    pieces = cut(bgzf.fragments(raw, BCF), "fragments")
    heads = pieces.where("header IS NOT NULL").select("header").distinct().take(2)  # one header, however many files
    if len(heads) > 1:
        raise ValueError("these files have different headers: read them one by one")
    header = parse_header(bytes(heads[0].header)[9:].rstrip(b"\0").decode().split("\n")) if heads else Header()
    strung = bgzf.joined(pieces).select("file", "data")

    def batches_of(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        rows = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        for record in records:
            rows.append(decode(record, header))
            if len(rows) * (1 + len(header.samples)) >= BATCH:
                yield out()
                rows.clear()
        if rows:
            yield out()

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split in bgzf.splits(batches):
            stream = bgzf.Stream(split, BCF)
            if stream.found:
                yield from batches_of(stream.records())

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from batches_of(bgzf.whole_records(data, BCF, file))

    return raw.mapInArrow(inside, ROWS).unionByName(strung.mapInArrow(across, ROWS))


def described(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + integers([[n]])


def integers(rows: list[list[int | None]]) -> bytes:
    """Vectors of integers of one width, the shorter ones ended, in the least type that holds them."""
    width, known = max(map(len, rows), default=0), [v for r in rows for v in r if v is not None]
    low, high = min(known, default=0), max(known, default=0)
    kind = INT8 if -121 < low and high < 128 else INT16 if -32761 < low and high < 32768 else INT32
    flat = [v for r in rows for v in [*(MISSING[kind] if x is None else x for x in r), *[END[kind]] * (width - len(r))]]
    return described(width, kind) + np.array(flat, KINDS[kind]).tobytes()


def reals(rows: list[list[float | None]]) -> bytes:
    width = max(map(len, rows), default=0)
    bits = lambda x: MISSING[FLOAT] if x is None else struct.unpack("<I", struct.pack("<f", x))[0]
    flat = [v for r in rows for v in [*map(bits, r), *[END[FLOAT]] * (width - len(r))]]
    return described(width, FLOAT) + np.array(flat, KINDS[FLOAT]).tobytes()


def characters(rows: list[str]) -> bytes:
    coded = [r.encode() for r in rows]
    width = max(map(len, coded), default=0)
    return described(width, CHAR) + b"".join(c.ljust(width, b"\0") for c in coded)


def values(kind: str, rows: list[str | None]) -> bytes:
    """The values of a field as its type in the header says; a point and null are missing."""
    if kind in ("Integer", "Float"):
        to = int if kind == "Integer" else float
        parsed = [[None if v == "." else to(v) for v in (r or ".").split(",")] for r in rows]
        return (integers if kind == "Integer" else reals)(parsed)
    return characters([r or "." for r in rows])


def genotype_values(rows: list[str | None]) -> bytes:
    part = lambda p: (0 if p.lstrip("|/") == "." else int(p.lstrip("|/")) + 1 << 1) | p.startswith("|")
    return integers([[part(p) for p in re.findall(r"[|/]?(?:\d+|\.)", r or ".")] for r in rows])


def encode(row: dict, header: Header, number: dict[str, int], contig: dict[str, int]) -> bytes:
    """One variant as a record; a name that the header does not have raises KeyError."""
    names = [row["ref"], *row["alts"]]
    fields = row["format"] or []
    many = len(header.samples)
    qual = struct.pack("<I", MISSING[FLOAT]) if row["qual"] is None else struct.pack("<f", row["qual"])
    fixed = struct.pack("<iii", contig[row["chrom"]], row["pos"] - 1, len(row["ref"])) + qual
    fixed += struct.pack("<II", len(names) << 16 | len(row["info"]), len(fields) << 24 | many)
    shared = [characters([row["id"] or "."]), *(characters([n]) for n in names), integers([[number[f] for f in row["filters"]]])]
    for name, value in row["info"]:
        kind = header.types["INFO", name]
        shared += [integers([[number[name]]]), described(0, 0) if kind == "Flag" or value is None else values(kind, [value])]
    own, called = [], [dict(s["fields"]) for s in row["samples"]]
    for name in fields:
        of = [c.get(name) for c in called]
        own += [integers([[number[name]]]), genotype_values(of) if name == "GT" else values(header.types["FORMAT", name], of)]
    head, tail = fixed + b"".join(shared), b"".join(own)
    return struct.pack("<II", len(head), len(tail)) + head + tail


def write_bcf(variants: DataFrame, path: str, header: list[str], samples: list[str], mode: str = "errorifexists") -> None:
    """A BCF file for each partition of variants (the columns of ``vcf.parse_vcf``), in order; committed by Spark.

    header: the ## lines, with contigs and the types of all fields that are used; a field that is not there fails the
    write. samples: their names, in the order of each row's samples.
    """
    columns = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *samples] if samples else [])
    text = ("\n".join([*header, "#" + "\t".join(columns)]) + "\n\0").encode()
    known = parse_header(text[:-2].decode().split("\n"))
    number, contig = ({name: i for i, name in of.items()} for of in (known.strings, known.contigs))
    start = MAGIC + struct.pack("<I", len(text)) + text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = start
        for batch in batches:
            rows = b"".join(encode(r, known, number, contig) for r in batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([before + rows], pa.binary())], names=["data"])
            before = b""

    bgzf.write_blocks(variants.select(*_ARROW.names).mapInArrow(run, "data binary"), path, mode)
