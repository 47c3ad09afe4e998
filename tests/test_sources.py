"""Readers and writers on small files made here."""

import gzip
import json
import random
import struct
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import cigar
from strandloom.sources import bam, fasta, fastq, gtf, sinks, text_tables, vcf
from strandloom.sources import bgzf as bgzf_source


def put(path, text):
    (gzip.open if str(path).endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


@pytest.mark.parametrize("name", ["a.fa", "a.fa.gz"])
def test_fasta(spark, tmp_path, name):
    path = put(tmp_path / name, ">chr1 first one\nACGT\r\n acg \n\n>chr2\n>chr3 x\nNNNN\nAC")
    rows = [tuple(r) for r in fasta.read_fasta(spark, path).collect()]
    assert rows == [("chr1", "chr1 first one", "ACGTacg"), ("chr2", "chr2", ""), ("chr3", "chr3 x", "NNNNAC")]
    fasta.check_fasta(spark, path)
    with pytest.raises(ValueError):
        fasta.check_fasta(spark, put(tmp_path / "b.fa", "ACGT\n>x\n"))
    found = fasta.seek(fasta.read_fasta(spark, path), spark.createDataFrame([("one",), ("chr3",)], "name string"))
    assert {(r.found, r.header) for r in found.collect()} == {("one", "chr1 first one"), ("chr3", "chr3 x")}


def test_chunks_and_context(spark):
    seq = "ACGTTGCAACGGNTTACGATCGATTT"
    df = spark.createDataFrame([("c", seq), ("short", "ACGTAC")], "name string, seq string")
    got = {(r.start, r.seq) for r in fasta.chunks(df, 10, 4).where("name = 'c'").collect()}
    assert got == {(i, seq[i : i + 14]) for i in (0, 10, 20)}
    points = spark.createDataFrame([("c", p) for p in range(len(seq))] + [("short", 5)], "chrom string, pos long")
    want = {}
    for p in range(len(seq)):
        at = max(0, min(p - 3, len(seq) - 6))
        w = seq[at : at + 6]
        want["c", p] = "AAAAAA" if "N" in w else w
    want["short", 5] = "ACGTAC"
    assert {(r.chrom, r.pos): r.context for r in fasta.context(points, df, size=10).collect()} == want
    with pytest.raises(Exception, match="no sequence"):
        fasta.context(spark.createDataFrame([("q", 1)], "chrom string, pos long"), df).collect()


FASTQ = "@r1 x\nACGT\n+\n@III\n@r2\nNNA\n+r2\n+@@\n"


@pytest.mark.parametrize("tail", ["", "\n"])
def test_fastq(spark, tmp_path, tail):
    rows = fastq.read_fastq(spark, put(tmp_path / "a.fastq.gz", FASTQ + tail)).orderBy("read_no").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "r1 x", "ACGT", "", "@III"), (1, "r2", "NNA", "r2", "+@@")]


def test_fastq_over_many_splits(spark, tmp_path):
    records = [(f"read{i}", "ACGT" * (i % 7), "", "@+#I" * (i % 7)) for i in range(3_000)]
    path = put(tmp_path / "a.fastq", "".join(f"@{i}\n{s}\n+{x}\n{q}\n" for i, s, x, q in records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        got = fastq.read_fastq(spark, path).orderBy("read_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r)[2:] for r in got] == records


def test_fastq_errors(spark, tmp_path):
    for i, text in enumerate(["r1\nA\n+\nI\n", "@r1\nA\n-\nI\n", "@r1\nA\n+\n"]):
        with pytest.raises(Exception, match="RuntimeException|USER_RAISED|no "):
            fastq.read_fastq(spark, put(tmp_path / f"{i}.fastq", text)).collect()


def test_fastq_pairs_and_writing(spark, tmp_path):
    one, two = put(tmp_path / "1.fastq", FASTQ), put(tmp_path / "2.fastq.gz", FASTQ.replace("r", "q"))
    pairs = fastq.read_fastq_pairs(spark, one, two)
    assert [(r.id_1, r.id_2) for r in pairs.orderBy("read_no").collect()] == [("r1 x", "q1 x"), ("r2", "q2")]
    assert fastq.read_fastq_pairs(spark, one, two, limit=1).count() == 1
    fastq.write_fastq(pairs, str(tmp_path / "out"), "_1")
    assert sorted(r.id for r in fastq.read_fastq(spark, str(tmp_path / "out")).collect()) == ["r1 x", "r2"]
    with pytest.raises(Exception, match="unequal"):
        fastq.read_fastq_pairs(spark, one, put(tmp_path / "3.fastq", FASTQ[: FASTQ.index("@r2")])).collect()


GTF = """#!comment
chr1\tH\tgene\t11\t90\t.\t-\t.\tgene_id "G1"; gene_name "A"; gene_type "protein_coding"; level 2; tag "x"; tag "y; z";
chr1\tH\texon\t11\t20\t2.5\t+\t0\tgene_id "G1"; exon_number 1
chr2\tH\tgene\t5\t9\t.\t.\t.\tgene_id "G2"; gene_type "lncRNA";
chr2\tH\tgene\t6\t9\t.\t.\t.\tgene_id "G3"; gene_name "old"; gene_name "new";
"""


def test_gtf(spark, tmp_path):
    df = gtf.read_gtf(spark, put(tmp_path / "a.gtf", GTF))
    first, second = df.collect()[:2]
    assert tuple(first)[:8] == ("chr1", "H", "gene", 11, 90, None, "-", None) and tuple(second)[2:8] == ("exon", 11, 20, 2.5, "+", 0)
    assert [tuple(a) for a in first.attrs][3:] == [("level", "2"), ("tag", "x"), ("tag", "y; z")]
    assert {tuple(r) for r in gtf.genes(df).collect()} == {("chr1", 11, 90, "G1", "A"), ("chr2", 6, 9, "G3", "new")}
    for bad in ("chr1\tH\tgene\t1\n", "\n", 'chr1\tH\tgene\t1\t2\t-3\t-\t.\tgene_id "G"\n'):
        with pytest.raises(Exception, match="no GTF row"):
            gtf.read_gtf(spark, put(tmp_path / "bad.gtf", GTF + bad)).collect()


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##INFO=<ID=H2,Type=Flag,Number=0,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
20\t14370\trs6\tG\tA\t29\tPASS\tDP=14;AF=0.5,0.1;H2\tGT:GQ:HQ\t0|0:48:51,.\t1/0:3
20\t17330\t.\tT\t.\t.\tq10;s50\t.\tGT\t0/0\t./1
20\t17331\t.\tGTC\tG,GTCT\t3.5\t.\tDP=x\tGT:DP\t1|2:4\t2
"""


def test_vcf(spark, tmp_path):
    path = put(tmp_path / "a.vcf", VCF)
    df = vcf.read_vcf(spark, path)
    a, b, c = df.collect()
    assert (a.chrom, a.pos, a.id, a.ref, a.alts, a.qual, a.filters) == ("20", 14370, "rs6", "G", ["A"], 29.0, ["PASS"])
    assert (b.id, b.alts, b.qual, b.filters, b.info) == (None, [], None, ["q10", "s50"], {}) and c.alts == ["G", "GTCT"] and c.filters == []
    assert a.samples[1].fields == {"GT": "1/0", "GQ": "3", "HQ": None}
    values = df.select(vcf.info_value("DP", "integral"), vcf.info_value("AF", "floating"), vcf.info_value("H2", "flag"), vcf.info_value("DP", "string"), vcf.format_values("HQ", "integral"), vcf.alleles()).collect()
    assert tuple(values[0]) == (14, 0.5, True, "14", [51, None, None], ["G", "A"]) and tuple(values[2])[:4] == (None, None, False, "x")
    g = df.select(F.transform("samples", lambda s: vcf.genotypes(s["fields"]["GT"])).alias("g"), vcf.heterozygous().alias("any"), vcf.heterozygous("S1").alias("one"), vcf.heterozygous("S9").alias("none")).collect()
    assert [tuple(x) for x in g[0].g[0]] == [(0, True, False), (0, True, False)] and [tuple(x) for x in g[1].g[1]] == [(-1, False, True), (1, False, False)]
    assert [(r.any, r.one, r.none) for r in g] == [(True, False, True), (True, False, True), (True, True, True)]
    header = vcf.read_vcf_header(spark, path)
    assert {(r.kind, r.id, r.type, r.description) for r in header.where("id IS NOT NULL").collect()} == {("INFO", "DP", "Integer", "Depth, total"), ("INFO", "H2", "Flag", "x")}
    assert [r.id for r in vcf.check_header(header).collect()] == ["H2"]
    assert vcf.chosen_samples(["S1", "S2"], "S2") == ["S2"] and vcf.chosen_samples(["S1", "S2"], "x") == ["S1", "S2"]
    with pytest.raises(Exception, match="no VCF row"):
        vcf.read_vcf(spark, put(tmp_path / "b.vcf", VCF + "20\t1\n")).collect()
    merged = vcf.merge_vcfs([df, df.where("pos = 17330")]).where("pos = 17330").first()
    assert [r.file for r in merged.records] == [0, 1]


def bgzf(data):
    """The bytes as gzip members with the extra field of BGZF, and an empty one at the end."""
    out = b""
    for at in [*range(0, len(data), 700), None]:
        part = b"" if at is None else data[at : at + 700]
        c = zlib.compressobj(wbits=-15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam_bytes(reads, header="@RG\tID:x\tSM:tumour\n"):
    out = b"BAM\1" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, pos, mapq, ops, seq in reads:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        r = struct.pack("<iiBBHHHiiii", 0 if pos >= 0 else -1, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for op, n in ops)
        r += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"I" * len(seq)
        out += struct.pack("<i", len(r)) + r
    return bgzf(out)


READS = [("a", 3, 10, 60, [("S", 1), ("M", 3), ("I", 2), ("M", 1), ("D", 2), ("=", 1), ("N", 5), ("X", 1)], "NACGTTACG"), ("b", 4, -1, 0, [], "ACG"), ("c", 1027, 12, 7, [("M", 2), ("H", 4)], "TT")] + [(f"r{i}", 3, 11, 60, [("M", 4)], "CGTA") for i in range(300)]


def test_bam(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam_bytes(READS))
    df = bam.read_bam(spark, str(tmp_path / "a.bam"))
    rows = df.orderBy("read_no").collect()
    assert len(rows) == len(READS) and rows[0].rg_sm == "tumour" and rows[1].chrom is None
    assert [(r.qname, r.flag, r.mapq, r.seq) for r in rows] == [(n, f, q, s) for n, f, _, q, _, s in READS]
    assert [tuple(c) for c in rows[0].cigar] == READS[0][4] and rows[0].pos0 == 10
    (tmp_path / "c.bam").write_bytes(b"nothing")
    with pytest.raises(Exception, match="Python worker|PythonException|error"):
        bam.read_bam(spark, str(tmp_path / "c.bam")).collect()


BAM_SCHEMA = "qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual binary"


def bam_reads(seed, n):
    r = random.Random(seed)
    for i in range(n):
        bases = 30_000 if i % 400 == 7 else r.choice([0, 1, 50, 151])
        ops = [(o, r.randint(0, 9)) for o in r.choices("MIDNSHP=X", k=r.randint(0, 5))]
        yield f"r{i}", r.choice([0, 2, 99]), r.choice(["c1", "c2", None]), r.choice([None, r.randint(0, 10**6)]), r.randint(0, 60), ops, "".join(r.choices("ACGTN", k=bases)), bytes(r.choices(range(60), k=bases))


@pytest.fixture
def cuts(spark):
    """Sets how large a split is."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda size: (spark.conf.set(names[0], size), spark.conf.set(names[1], 1))
    for name in names:
        spark.conf.unset(name)


def test_bam_is_the_same_in_any_splits(spark, tmp_path, cuts):
    """Two files with records longer than a split; every cut gives the same rows, numbers included, in as many tasks as there are splits."""
    rows = list(bam_reads(1, 1_200))
    path = str(tmp_path / "bam")
    bam.write_bam(spark.createDataFrame(rows, BAM_SCHEMA).repartition(2), path, {"c1": 10**6, "c2": 5}, "tumour")
    want = sorted((q, f, c, -1 if p is None else p, m, o, s, b) for q, f, c, p, m, o, s, b in rows)
    numbers = None
    for size in (10**9, 1 << 16, 9_973, 2_500):
        cuts(size)
        df = bam.read_bam(spark, path)
        got = df.collect()
        assert sorted((r.qname, r.flag, r.chrom, r.pos0, r.mapq, [tuple(c) for c in r.cigar], r.seq, bytes(r.qual)) for r in got) == want
        assert {r.rg_sm for r in got} == {"tumour"}
        own = {(r.file, r.read_no, r.qname) for r in got}
        assert numbers in (None, own) and len(own) == len(rows)
        numbers = own
    assert bam.bgzf.raw_blocks(spark, path).rdd.getNumPartitions() > 40
    few = bam.read_bam(spark, path, ["flag"])
    assert few.columns == ["flag"] and sorted(r.flag for r in few.collect()) == sorted(r[1] for r in rows)
    for file in (tmp_path / "bam").glob("part-*"):  # any reader of gzip members reads what was written
        assert gzip.open(file).read(4) == b"BAM\1" and file.read_bytes().endswith(bam.bgzf.END)
    with pytest.raises(ValueError):
        bam.read_bam(spark, path, ["nothing"])


def test_bam_that_is_broken(spark, tmp_path):
    whole = bam_bytes(READS)
    half = len(whole) // 2
    (tmp_path / "cut.bam").write_bytes(whole[:-40])
    (tmp_path / "bad.bam").write_bytes(whole[:half] + bytes([whole[half] ^ 1]) + whole[half + 1 :])
    (tmp_path / "none.bam").write_bytes(b"")
    for name in ("cut", "bad"):
        with pytest.raises(Exception, match="BGZF|broken|record|invalid|Error"):
            bam.read_bam(spark, str(tmp_path / f"{name}.bam"), ["qname"]).collect()
    assert bam.read_bam(spark, str(tmp_path / "none.bam"), ["qname"]).count() == 0


def test_separators_inside_blocks():
    """A separator that occurs in the data of a block is no cut."""
    inner = bgzf_source.SEPARATOR.encode()
    data = b"ab" + inner + b"cd" + inner * 2
    body = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = body.compress(data) + body.flush()  # stored, so that the separators are seen
    block = bgzf_source.HEADER + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    values = (block + bgzf_source.compressed(b"more") + bgzf_source.END).split(inner)
    assert len(values) > 5 and list(bgzf_source.inflated(iter(values), "f", 0)) == [data, b"more"]


def test_failed_writer_leaves_no_file(spark, tmp_path):
    rows = list(bam_reads(2, 50)) + [("x", 0, "unknown", 1, 0, [], "A", b"1")]
    with pytest.raises(Exception, match="unknown"):
        bam.write_bam(spark.createDataFrame(rows, BAM_SCHEMA).repartition(3), str(tmp_path / "w"), {"c1": 9, "c2": 9})
    assert not list((tmp_path / "w").glob("part-*")) and not (tmp_path / "w" / "_SUCCESS").exists()


def test_sample_of_reads(spark, tmp_path):
    for name, header in (("a.bam", "@RG\tID:x\tSM:tumour\n"), ("b.bam", "@HD\tVN:1\n")):
        (tmp_path / name).write_bytes(bam_bytes(READS[:3], header))
    df = bam.with_sample(bam.read_bam(spark, str(tmp_path / "*.bam"), ["file", "rg_sm", "qname"]))
    assert Counter(r["sample"] for r in df.collect()) == {"tumour": 3, "b.bam": 3}


def test_cigar_walks(spark):
    sam = spark.createDataFrame([("a\t3\tchr1\t11\t60\t1S3M2I1M2D1=5N1X\t*\t0\t0\tNACGTTACG\t*",), ("@HD\tx",)], "value string")
    df = bam.parse_sam(sam).select("qname", "chrom", "pos0", "cigar", "seq")
    walk = lambda emit: [(r.pos, r.allele) for r in cigar.explode_cigar(df, emit).collect()]
    assert walk("alleles") == [(10, "A"), (11, "C"), (12, "G"), (13, "TT"), (13, "A"), (16, "C"), (22, "G")]
    assert walk("pileup") == [(10, "A"), (11, "C"), (12, "G"), (13, "+TT"), (13, "A"), (14, "-2"), (16, "C"), (22, "G")]
    assert [p for p, _ in walk("depth")] == [10, 11, 12, 13, 14, 15, 16, 22]


def test_depth_drops_bad_reads(spark):
    rows = [("c", 0, "2M", "AC", 3), ("c", 1, "1M1D1M", "AC", 3), ("c", 0, "2M", "AC", 7), ("c", 0, "2M", "AC", 1027), ("c", 0, "2M", "AC", 1)]
    df = spark.createDataFrame(rows, "chrom string, pos0 long, c string, seq string, flag int").withColumn("cigar", cigar.parse_cigar(F.col("c")))
    assert {(r.pos, r.depth) for r in cigar.depth(df).collect()} == {(0, 1), (1, 2), (2, 1), (3, 1)}


def test_text_tables(spark, tmp_path):
    path = put(tmp_path / "a.tsv", 'Gene Symbol\tn\nA"B\t1\nC\t\n')
    df = text_tables.read_tsv(spark, path)
    assert [tuple(r) for r in df.collect()] == [('A"B', "1"), ("C", "")]
    with pytest.raises(ValueError):
        text_tables.read_tsv(spark, path, columns=["zz"])
    assert {r.gene for r in text_tables.read_gene_list(spark, path).collect()} == {'A"B', "C"}
    bed = put(tmp_path / "a.bed", "1\t0\t10\n1\t10\t12\n2\t5\t6\n")
    assert {tuple(r) for r in text_tables.read_bed(spark, bed).collect()} == {("1", 0, 12), ("2", 5, 6)}
    sinks.write_tsv(df, str(tmp_path / "out"), one_file=True)
    assert sorted(map(tuple, text_tables.read_tsv(spark, str(tmp_path / "out")).collect())) == [('A"B', "1"), ("C", "")]


def test_json_and_matrix(spark, tmp_path):
    counts = spark.createDataFrame([("s", "read1", "fwd", 0, 1, 3), ("s", "read1", "rev", 0, 2, 3), ("s", "read1", "fwd", 1, 0, 2), ("s", "read2", "fwd", 0, 3, 1)], "sample string, read string, strand string, pos long, kmer long, n long")
    doc = json.loads(sinks.counts_json(counts, 1).first().value)
    assert doc["K"] == 1 and doc["read1"]["fwd"] == [[0, 3, 0, 0], [2, 0, 0, 0]] and doc["read2"]["rev"] == []
    back = text_tables.read_counts(spark, put(tmp_path / "c.json", json.dumps(doc, indent=1)))
    assert {tuple(r) for r in back.drop("K").collect()} == {tuple(r) for r in counts.collect()}
    wide = {r.kmer: r for r in sinks.matrix(counts, 1, "n", 2, 1, spark.createDataFrame([(1, 0.5)], "kmer long, p double")).collect()}
    assert set(wide) == set("ACGT") and (wide["C"].L0f, wide["A"].L1f, wide["T"].R0f, wide["G"].L1r, wide["C"]["global"]) == (3, 2, 1, 0, 0.5)
    models = spark.createDataFrame([("AAAAAA", 5, 1.5, 2.5)], "context string, N long, k double, theta double")
    path = put(tmp_path / "g.json", sinks.gamma_json(models).first().value)
    assert [tuple(r) for r in text_tables.read_gamma(spark, path).collect()] == [("AAAAAA", 5, 1.5, 2.5)]


def test_small_chunks_share_batches(spark, monkeypatch):
    """The kernel gives out a batch for many chunks, and the chunks are those of the sequence."""
    seen = []
    df = spark.createDataFrame([("a", "ACGT" * 50), ("b", None), ("c", "AC")], "name string, seq string").coalesce(1)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: seen.extend(run(self.toArrow().to_batches())))
    fasta.chunks(df, 10, 3)
    rows = [r for b in seen for r in b.to_pylist()]
    assert len(seen) == 1 and len(rows) == 21 and rows[1] == {"name": "a", "chunk": 1, "start": 10, "seq": ("ACGT" * 50)[10:23]}


def plain_record(number, qname, flag, chrom, pos, mapq, ops, seq, qual):
    """One record of a BAM file, field by field."""
    name, seq, code = (qname or "*").encode() + b"\0", seq or "", lambda c: bam.LETTERS.index(c) if c in bam.LETTERS else 15
    half = [code(c.upper()) for c in seq] + [0] * (len(seq) % 2)
    fixed = struct.pack("<iiBBHHHiiii", -1 if chrom is None else number[chrom], -1 if pos is None else pos, len(name), mapq, 0, len(ops or []), flag, len(seq), -1, -1, 0)
    body = fixed + name + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for o, n in ops or []) + bytes(a << 4 | b for a, b in zip(half[::2], half[1::2], strict=True))
    body += b"\xff" * len(seq) if qual is None else qual
    return struct.pack("<i", len(body)) + body


@pytest.mark.parametrize("most", [1, 300, 1 << 24])
def test_bam_records_are_packed_by_column(monkeypatch, most):
    """Columns of a batch become the records that each row gives by itself, from arrays or texts of CIGARs, in pieces of any size."""
    monkeypatch.setattr(bam, "BATCH_BYTES", most)
    r, number = random.Random(most), {"c1": 0, "é2": 1}
    rows = []
    for i in range(60):
        seq = r.choice([None, "", "".join(r.choice("ACGTUNacgtn=é") for _ in range(r.randint(1, 9)))])
        ops = [(r.choice(bam.OPERATIONS), r.choice([0, 1, 70, (1 << 28) - 1])) for _ in range(r.randint(0, 5))]
        rows.append((r.choice([None, "", "r", f"ré{i}"]), r.choice([0, 2, 65535]), r.choice([None, *number]), r.choice([None, -1, 0, i, 1 << 30]), r.choice([0, 60, 255]), ops if i % 7 else None, seq, r.choice([None, bytes(range(len(seq or "")))])))
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), pa.string(), pa.binary())
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[5] = [None if ops is None else [{"op": o, "len": n} for o, n in ops] for ops in columns[5]]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    texts = [*arrays[:5], pa.array([None if x is None else "".join(f"{n}{o}" for o, n in x) or "*" for x in (row[5] for row in rows)], pa.string()), *arrays[6:]]
    names = [str(i) for i in range(8)]
    whole = b"".join(plain_record(number, *x) for x in rows)
    for made in (arrays, texts):
        batch = pa.RecordBatch.from_arrays(made, names=names)
        assert b"".join(bam.encode(batch, number)) == whole
        assert b"".join(bam.encode(batch.slice(50), number)) == b"".join(plain_record(number, *x) for x in rows[50:])
    assert b"".join(bam.encode(batch.slice(60), number)) == b""
    good = dict(zip(names, (["r"], [0], ["c1"], [1], [0], ["1M"], ["A"], [None]), strict=True))
    for field, bad in (("1", [1 << 16]), ("1", [None]), ("2", ["c9"]), ("3", [1 << 31]), ("4", [256]), ("5", ["268435456M"]), ("0", ["r" * 255])):
        batch = pa.RecordBatch.from_arrays([pa.array((good | {field: bad})[n], t.type) for n, t in zip(names, texts, strict=True)], names=names)
        with pytest.raises(ValueError):
            list(bam.encode(batch, number))
