"""BCF against the same variants as text, in any splits."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.sources import bcf, bgzf, vcf

HEADER = [
    "##fileformat=VCFv4.2", "##contig=<ID=c1>", "##contig=<ID=c2>", '##FILTER=<ID=q10,Description="x, ID=no">',
    *(f'##INFO=<ID={i},Number=.,Type={t},Description="x">' for i, t in (("DP", "Integer"), ("AF", "Float"), ("H2", "Flag"), ("AA", "String"))),
    *(f'##FORMAT=<ID={i},Number=.,Type={t},Description="x">' for i, t in (("GT", "String"), ("DP", "Integer"), ("GL", "Float"), ("FT", "String"))),
]


def variants(n, seed=0):
    """Lines with integers of all widths, long alleles and vectors, missing values of every kind and dropped fields."""
    rng = random.Random(seed)
    pick = lambda *of: rng.choice(of)
    number = lambda: str(rng.choice([0, -1, 100, -120, -121, 127, 128, -32760, 32767, 32768, 2**31 - 1, -(2**31) + 8]))
    for i in range(n):
        info = pick(".", "DP=" + number(), "H2;AF=0.5,.,0.25;AA=x", "AA=" + "y" * pick(1, 14, 15, 200) + ";DP=.", "DP=" + ",".join(number() for _ in range(20)))
        call = lambda: pick("0|1:5:0.5,-1e-05:PASS", "./.", "1:.", "0/1/2:" + number() + ",.:.:a", "10|.:3:1.5", ".:7:.:bcd")  # noqa: E731, B023
        yield "\t".join([pick("c1", "c2"), str(i + 1), pick(".", f"rs{i}"), pick("A", "ACGT" * 10), pick(".", "C", "C,GT,<DEL>"), pick(".", "0", "29.5", "1e+06"), pick(".", "PASS", "q10"), info, "GT:DP:GL:FT", call(), call()])


def as_rows(df):
    plain = lambda r: r.asDict(True)
    return sorted((plain(r) for r in df.collect()), key=lambda r: r["pos"])


@pytest.mark.parametrize("size", [2_500, 20_000, 1 << 30])
def test_bcf_has_the_rows_of_the_vcf(spark, tmp_path, size):
    lines = spark.createDataFrame([(x,) for x in variants(1_000)], "value string")
    df = vcf.parse_vcf(lines, ["S1", "S2"])
    path = str(tmp_path / "bcf")
    bcf.write_bcf(df.repartition(2), path, HEADER, ["S1", "S2"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = as_rows(bcf.read_bcf(spark, path))
        tasks = bgzf.raw_blocks(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == as_rows(df) and (tasks > 4 or size > 1 << 20)
    for file in (tmp_path / "bcf").glob("part-*"):
        assert gzip.open(file).read(5) == bcf.MAGIC


def test_bytes_of_a_record_made_by_hand(spark):
    """A record laid out by the public description of the format, byte by byte."""
    header = bcf.parse_header([*HEADER, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA1\tNA2"])
    shared = struct.pack("<iiifII", 1, 99, 1, 30.0, 2 << 16 | 2, 2 << 24 | 2) + b"\x37rs1" + b"\x17A" + b"\x17C" + b"\x11\x00"
    shared += b"\x11\x02" + b"\x12\x2c\x01" + b"\x11\x04" + b"\x00"  # DP=300 as int16, the flag H2
    own = b"\x11\x06" + b"\x21\x02\x05\x04\x81" + b"\x11\x02" + b"\x11\x0a\x80"  # GT 0|1 and 1 ended early, DP 10 and missing
    row = bcf.decode(struct.pack("<II", len(shared), len(own)) + shared + own, header)
    assert row[:9] == ("c2", 100, "rs1", "A", ["C"], 30.0, ["PASS"], [("DP", "300"), ("H2", None)], ["GT", "DP"])
    assert row[9] == [{"name": "NA1", "fields": [("GT", "0|1"), ("DP", "10")]}, {"name": "NA2", "fields": [("GT", "1"), ("DP", None)]}]
    moved = bcf.parse_header(['##INFO=<ID=B,Type=Integer,IDX=7>', '##FILTER=<ID=q,IDX=3>', "##contig=<ID=x,IDX=5>"])
    assert moved.strings == {0: "PASS", 7: "B", 3: "q"} and moved.contigs == {5: "x"}


def test_bcf_edges(spark, tmp_path):
    empty = vcf.parse_vcf(spark.createDataFrame([], "value string"), [])
    bcf.write_bcf(empty, str(tmp_path / "none"), HEADER, [])
    assert bcf.read_bcf(spark, str(tmp_path / "none")).count() == 0
    alone = vcf.parse_vcf(spark.createDataFrame([("c1\t5\t.\tA\tC\t.\t.\tDP=3",)], "value string"), [])
    bcf.write_bcf(alone, str(tmp_path / "alone"), HEADER, [])
    assert as_rows(bcf.read_bcf(spark, str(tmp_path / "alone"))) == as_rows(alone)
    bcf.write_bcf(alone, str(tmp_path / "other"), HEADER[:-1], [])
    with pytest.raises(ValueError, match="different headers"):
        bcf.read_bcf(spark, [str(tmp_path / "alone"), str(tmp_path / "other")])
    with pytest.raises(Exception, match="KeyError"):
        bcf.write_bcf(alone.withColumn("info", F.create_map(F.lit("ZZ"), F.lit("1"))), str(tmp_path / "bad"), HEADER, [])
    bgzf.write_blocks(spark.createDataFrame([(bytearray(b"BAM\1 is another"),)], "data binary"), str(tmp_path / "bam"))
    with pytest.raises(Exception, match="no BCF"):
        bcf.read_bcf(spark, str(tmp_path / "bam"))
