"""FASTA in splits: chunks and contexts are the same wherever the files are cut."""

import random

import pytest

from strandloom.sources import fasta, fasta_splits


def fixture(path, seed):
    """A file of sequences of many sizes, with empty ones, blank lines and marks of Windows; and its records."""
    rng, records, out = random.Random(seed), [], []
    for i, n in enumerate([0, 5, 3000, 1, 0, 700, 64, 63, 2000, 0]):
        seq = "".join(rng.choices("ACGTNacgt", k=n))
        records.append((f"c{i}", f"c{i} of  {seed}", seq))
        out.append(f">c{i} of  {seed} \r\n" + "".join(seq[at : at + 50] + rng.choice(["\n", "\r\n", "\n\n", " \n"]) for at in range(0, n, 50)))
    path.write_text("".join(out))
    return str(path), records


@pytest.mark.parametrize("split", [97, 331, 1 << 20])
def test_chunks_are_whole_in_any_splits(spark, tmp_path, split):
    path, records = fixture(tmp_path / "a.fa", split)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = fasta_splits.read_fasta_chunks(spark, path, size=100, overlap=20).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_record = {}
    for r in sorted(rows, key=lambda r: (r.record, r.start)):
        by_record.setdefault(r.record, []).append(r)
    assert sorted(by_record) == list(range(len(records)))
    for i, (name, header, seq) in enumerate(records):
        chunks = by_record[i]
        assert {(c.name, c.header) for c in chunks} == {(name, header)}
        assert [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True]
        at = 0
        for c in chunks:
            assert (c.start, c.seq) == (at, seq[at : at + c.own + 20]) and c.own <= 100
            at += c.own
        assert at == len(seq)


@pytest.mark.parametrize("split", [150])
def test_context_is_that_of_whole_records(spark, tmp_path, split):
    path, records = fixture(tmp_path / "a.fa", 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        fasta_splits.read_fasta_chunks(spark, path, size=64, overlap=6).write.parquet(str(tmp_path / "chunks"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert {(r.name, r.length) for r in fasta_splits.lengths(chunks).collect()} == {(n, len(s)) for n, _, s in records}
    points = spark.createDataFrame([(n, p) for n, _, s in records if s for p in [*range(0, len(s), 3), len(s) - 1, len(s) + 9]], "chrom string, pos long")
    whole = spark.createDataFrame(records, "name string, header string, seq string")
    got = fasta_splits.chunk_context(points, chunks, size=64).collect()
    want = fasta.context(points, whole, size=64).collect()
    assert sorted((r.chrom, r.pos, r.context) for r in got) == sorted((r.chrom, r.pos, r.context) for r in want)
    with pytest.raises(Exception, match="no sequence"):
        fasta_splits.chunk_context(spark.createDataFrame([("q", 1)], "chrom string, pos long"), chunks, size=64).collect()


def test_what_is_no_fasta(spark, tmp_path):
    for name, data in (("b.fa", "ACGT\n>x\n"), ("c.fa", ">x\nACé\n")):
        (tmp_path / name).write_text(data)
        with pytest.raises(Exception, match="does not begin|no ASCII"):
            fasta_splits.read_fasta_chunks(spark, str(tmp_path / name)).collect()
    (tmp_path / "empty.fa").write_text("")
    assert fasta_splits.read_fasta_chunks(spark, str(tmp_path / "empty.fa")).count() == 0
