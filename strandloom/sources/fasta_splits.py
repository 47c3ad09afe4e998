"""FASTA files with sequences of any size: read in splits as chunks, so that no sequence is ever one row.

Spark cuts the files into splits of whole lines. One pass over them keeps a small row for each split: how many records
begin there, how many bases lie before the first of them and after the last. Put in order, these rows tell which record
a split begins in and how far in, and which bases follow its end. A second pass cuts each split into chunks by itself;
no bases are shuffled but those few that a chunk shows beyond the end of its split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.strings import first_word, trimmed
from strandloom.sources.shared import cut, discard

ENDS = "file string, start long, headers long, lead long, head string, tail long, last string"
PLACES = "file string, start long, number long, header string, offset long, rest long, after string"
PIECES = "file string, start long, nth long, header string, at long, own long, final boolean, open boolean, seq string"


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, str | None, bytes]]:
    """(file, start of the split, header, bases): what follows each header, or goes on in the next batch, in order."""
    for batch in batches:
        file, start, raw = batch.columns
        if not batch.num_rows:
            continue
        lines = pc.ascii_trim_whitespace(raw.cast(pa.large_string()))
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = lines.buffers()[2]
        opens = pc.starts_with(raw, ">").to_numpy(zero_copy_only=False)
        files, starts = file.dictionary_encode().indices.to_numpy(), start.to_numpy()
        changes = (files[1:] != files[:-1]) | (starts[1:] != starts[:-1])
        cuts = np.union1d(np.concatenate(([0], np.flatnonzero(changes) + 1)), np.flatnonzero(opens)).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            header = lines[a].as_py() if opens[a] else None
            first = a + (header is not None)
            bases = data.slice(int(ends[first]), int(ends[b] - ends[first])).to_pybytes() if data is not None else b""
            if not bases.isascii():
                raise ValueError(f"{file[a].as_py()} has letters that are no ASCII in a sequence")
            yield file[a].as_py(), int(starts[a]), header, bases


def split_ends(lines: DataFrame, overlap: int) -> DataFrame:
    """One row for each split, as ENDS has it: the bases before its first header and those after its last."""

    def out(row: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("file", "start", "headers", "lead", "head", "tail", "last"), row, strict=True))], pa.schema(_arrow(ENDS)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = None
        for file, start, header, bases in runs(batches):
            if row is None or row[:2] != [file, start]:
                if row:
                    yield out(row)
                row = [file, start, 0, 0, "", 0, None]
                if start == 0 and header is None:
                    raise ValueError(f"{file} does not begin with >")
            if header is not None:
                row[2], row[5], row[6] = row[2] + 1, 0, header
            if row[2]:
                row[5] += len(bases)
            else:
                row[3] += len(bases)
                row[4] += bases[: overlap - len(row[4])].decode()
        if row:
            yield out(row)

    return lines.mapInArrow(run, ENDS)


def split_places(overlap: int, ends: pd.DataFrame) -> pd.DataFrame:
    """One file's rows as PLACES has them: the record that a split begins in, the bases of it before the split, how many
    bases of the record open at its end come later, and the first of these."""
    rows = ends.sort_values("start").to_dict("records")
    number, header, offset = -1, None, 0
    for row in rows:
        row["number"], row["header"], row["offset"] = number, header, offset
        if row["headers"]:
            number, header, offset = number + row["headers"], row["last"], row["tail"]
        else:
            offset += row["lead"]
    after, rest = "", 0
    for row in reversed(rows):
        row["after"], row["rest"] = after, rest
        after = row["head"] if row["headers"] else (row["head"] + after)[:overlap]
        rest = row["lead"] + (0 if row["headers"] else rest)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])


def split_pieces(lines: DataFrame, size: int, overlap: int) -> DataFrame:
    """The chunks of each split by itself, as PIECES has them; nth counts the records of a split, 0 is the one it begins in."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = bytearray(), None  # now: file, start, nth, header, place in the split's part of the record
        rows: list[tuple] = []

        def cut_off(least: int, ended: bool | None) -> None:
            """Chunks while more than least bases are held; ended: whether the record is at the end of its part, None within it."""
            done = 0
            while len(held) - done > least:
                own = min(size, len(held) - done)
                final = ended is not None and done + own == len(held)
                rows.append((*now, own, final, ended is False, bytes(held[done : done + own + overlap]).decode()))
                now[4] += own
                done += own
            if ended is not None and now[4] == 0 and now[3] is not None:  # a header without bases, so far
                rows.append((*now, 0, True, not ended, ""))
            del held[:done]

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _arrow(PIECES), strict=True)], names=names)
                rows.clear()

        for file, start, header, bases in runs(batches):
            if now is None or now[:2] != [file, start]:
                if now:
                    cut_off(0, False)
                now = [file, start, 0, None, 0]
            if header is not None:
                cut_off(0, True)
                now[2:] = [now[2] + 1, header, 0]
            held += bases
            cut_off(size + overlap, None)
            if len(rows) * min(size, 1 << 10) > 1 << 22:
                yield from flush()
        if now:
            cut_off(0, False)
        yield from flush()

    return lines.mapInArrow(run, PIECES)


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return [(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))]


def read_fasta_chunks(spark: SparkSession, path: str | list[str], size: int = 1 << 20, overlap: int = 63) -> DataFrame:
    """file, record, name, header, start, own, last, seq: chunks of the sequences of FASTA files of any size.

    record counts the records of a file from 0. own bases from start on belong to a chunk, at most size; seq shows up to
    overlap bases more where the sequence has them, so a window of overlap + 1 bases lies wholly in the chunk in which
    it begins. last marks the chunk in which a sequence ends; start + own is its length there. A record without bases is
    one chunk of none; an empty file has no records. Lines are trimmed; a file that does not begin with > and letters
    that are no ASCII raise ValueError when rows are read. A file in a codec that cannot be split is one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    ends = cut(split_ends(lines, overlap), "ends")
    placing = ends.groupBy("file").applyInPandas(lambda rows: split_places(overlap, rows), PLACES)  # a row for each split of a file
    places = cut(placing, "places")
    discard(ends)
    placed = split_pieces(lines, size, overlap).join(places.withColumnRenamed("header", "before"), ["file", "start"])
    placed = placed.where((F.col("own") > 0) | ~F.col("open") | (F.col("rest") == 0))
    goes_on = F.col("nth") == 0
    header = trimmed(F.regexp_replace(F.when(goes_on, F.col("before")).otherwise(F.col("header")), "^>", ""))
    missing = (F.lit(overlap) - F.length("seq") + F.col("own")).cast("int")  # above 0 only at the end of a split or sequence
    shown = F.when(F.col("open"), F.concat("seq", F.substring("after", F.lit(1), missing))).otherwise(F.col("seq"))
    return placed.select(
        "file", (F.col("number") + F.col("nth")).alias("record"), first_word(header).alias("name"), header.alias("header"),
        (F.col("at") + F.when(goes_on, F.col("offset")).otherwise(0)).alias("start"), "own",
        (F.col("final") & (~F.col("open") | (F.col("rest") == 0))).alias("last"), shown.alias("seq"),
    )


def lengths(chunks: DataFrame) -> DataFrame:
    """file, record, name, header, length of every sequence; of chunks that are stored, no bases are read."""
    return chunks.where("last").select("file", "record", "name", "header", (F.col("start") + F.col("own")).alias("length"))


def chunk_context(points: DataFrame, chunks: DataFrame, *, on: str = "chrom", point: str = "pos", size: int = 1 << 20) -> DataFrame:
    """points with context as ``fasta.context`` has it, from chunks of at most size bases and an overlap of 5 or more.

    Store the chunks first, as they are read more than once. Chunks go by the ranges of size in which their bases lie,
    at most two; only those in whose ranges there are points meet them. Names must be those of one record each.
    """
    known = lengths(chunks).select(F.col("name").alias(on), F.col("length").alias("_len"))
    at = F.greatest(F.lit(0), F.least(F.col(point) - 3, F.col("_len") - 6)).cast("long")
    placed = points.join(known, on, "left").withColumn("_at", at)
    placed = placed.withColumn("_at", F.when(F.col("_len").isNull(), F.raise_error(F.concat(F.lit("no sequence "), F.col(on))).cast("long")).otherwise(F.col("_at")))
    placed = placed.withColumn("_bin", F.floor(F.col("_at") / size))
    first, final = F.floor(F.col("start") / size), F.floor((F.col("start") + F.greatest(F.col("own"), F.lit(1)) - 1) / size)
    of = chunks.where((F.col("own") > 0) | F.col("last")).select(
        F.col("name").alias(on), F.explode(F.sequence(first, final)).alias("_bin"), F.col("start").alias("_start"),
        (F.col("start") + F.greatest(F.col("own"), F.lit(1))).alias("_end"), F.col("seq").alias("_seq"),
    )
    of = of.join(placed.select(on, "_bin").distinct(), [on, "_bin"], "left_semi").withColumnsRenamed({on: "_on", "_bin": "_of"})
    here = (F.col(on) == F.col("_on")) & (F.col("_bin") == F.col("_of")) & (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))
    six = F.upper(F.substring("_seq", (F.col("_at") - F.col("_start") + 1).cast("int"), F.lit(6)))
    known_six = F.when(six.rlike("^[ACGT]{6}$"), six).otherwise(F.lit("AAAAAA"))
    return placed.join(of, here, "left").withColumn("context", known_six).drop("_len", "_at", "_bin", "_on", "_of", "_start", "_end", "_seq")
