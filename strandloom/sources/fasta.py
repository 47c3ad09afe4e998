"""FASTA."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.strings import WHITE, first_word, trimmed, words

#: Chunks and bases that share a batch, at most (a longer chunk is one of its own).
BATCH_ROWS, BATCH_BASES = 8192, 1 << 22


def parse_fasta(records: DataFrame, value: str = "value") -> DataFrame:
    """name (first word of the header), header (without >), seq (lines joined) of texts that each hold one record.

    The mark > at the start of a record may be missing, as a reader that cuts at it takes it away.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(value, r"^>", ""), "\r", ""), "\n")
    header = trimmed(F.element_at(lines, 1))
    seq = F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.btrim(x, F.lit(WHITE))), "")
    some = records.where(F.length(F.btrim(value, F.lit(WHITE))) > 0)
    return some.select(first_word(header).alias("name"), header.alias("header"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every record of FASTA files, as parse_fasta has it; a file that does not begin with > raises ValueError.

    One record is one row: sequences of chromosomes are cut with ``chunks`` right after.
    """
    check_fasta(spark, path)
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def check_fasta(spark: SparkSession, path: str | list[str]) -> None:
    """Raise ValueError for a file whose first byte is not >; only that byte of each file is read."""
    java = spark.sparkContext._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = java.io.compress.CompressionCodecFactory(conf)
    for file in spark.read.text(path).inputFiles():
        place = java.fs.Path(spark.sparkContext._jvm.java.net.URI(file))
        stream = place.getFileSystem(conf).open(place)
        codec = codecs.getCodec(place)
        stream = codec.createInputStream(stream) if codec else stream
        first = stream.read()
        stream.close()
        if first not in (-1, ord(">")):
            raise ValueError(f"{file} does not begin with >")


def seek(records: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Records whose header has one of the names as any of its words, with that name as found."""
    wanted = names.select(F.col(name).alias("found")).distinct()
    return records.withColumn("found", F.explode(F.array_distinct(words(F.col("header"))))).join(wanted, "found")


def chunks(records: DataFrame, size: int = 1 << 20, overlap: int = 63) -> DataFrame:
    """name, chunk, start, seq: sequences cut into pieces of size that carry the next overlap bases too.

    A window of up to overlap + 1 bases that starts in a chunk lies wholly in it; only starts below
    start + size belong to it.
    """

    def out(held: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "chunk", "start", "seq"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0  # small chunks share a batch
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, at in enumerate(range(0, len(seq or ""), size)):
                    held.append((name, i, at, seq[at : at + size + overlap]))
                    total += len(held[-1][3])
                    if len(held) == BATCH_ROWS or total >= BATCH_BASES:
                        yield out(held)
                        held, total = [], 0
        if held:
            yield out(held)

    return records.select("name", "seq").mapInArrow(run, "name string, chunk long, start long, seq string")


def context(points: DataFrame, records: DataFrame, *, on: str = "chrom", point: str = "pos", size: int = 1 << 20) -> DataFrame:
    """points with context: the six bases [pos - 3, pos + 3) around a 0-based position.

    Near the ends the window is moved inside; a window with a letter that is no base is AAAAAA. A point on a
    sequence that is not there raises an error when rows are read.
    """
    lengths = records.select(F.col("name").alias(on), F.length("seq").alias("_len"))
    cut = chunks(records, size, 6).select(F.col("name").alias(on), F.col("chunk").alias("_chunk"), F.col("start").alias("_start"), F.col("seq").alias("_seq"))
    at = F.greatest(F.lit(0), F.least(F.col(point) - 3, F.col("_len") - 6))
    placed = points.join(lengths, on, "left").withColumn("_at", at.cast("long")).withColumn("_chunk", F.floor(F.col("_at") / size))
    six = F.upper(F.substring("_seq", (F.col("_at") - F.col("_start") + 1).cast("int"), F.lit(6)))
    known = F.when(F.col("_seq").isNull(), F.raise_error(F.concat(F.lit("no sequence "), F.col(on))).cast("string")).when(six.rlike("^[ACGT]{6}$"), six).otherwise(F.lit("AAAAAA"))
    return placed.join(cut, [on, "_chunk"], "left").withColumn("context", known).drop("_len", "_at", "_chunk", "_start", "_seq")
