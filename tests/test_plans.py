"""Pipelines end to end on small inputs with results worked out by hand."""

import json
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import strings as st
from strandloom.functions.kmers import decode
from strandloom.functions.stats import chi2_tail
from strandloom.operators import cigar, pileup
from strandloom.plans import ase, bait_scan, depletion, divergence, kmer_bias
from strandloom.sources import sinks

ALIGNMENTS = "sample string, chrom string, pos0 long, c string, seq string, flag int, mapq int"


def aligned(spark, rows):
    return spark.createDataFrame(rows, ALIGNMENTS).withColumn("cigar", cigar.parse_cigar(F.col("c")))


def test_allele_specific_expression(spark):
    genes = spark.createDataFrame([("1", 1, 10, "old", "OLD", 0), ("1", 1, 10, "g1", "ONE", 1), ("1", 5, 30, "g2", "TWO", 2), ("1", 100, 110, "g3", "THREE", 3)], "chrom string, lo long, hi long, gene_id string, gene_name string, line long")
    sites = spark.createDataFrame([("1", 3, 0, ["A", "C"]), ("1", 6, 1, ["G", "T"]), ("1", 20, 2, ["A", "T"]), ("1", 105, 3, ["A", "T"]), ("2", 3, 4, ["A", "C"])], "chrom string, pos long, ord long, alleles array<string>")
    reads = [("s", "1", 2, "1M", "A", 3, 60)] * 30 + [("s", "1", 2, "1M", "C", 3, 60)] * 2 + [("s", "1", 5, "1M", "T", 3, 60)] * 25 + [("s", "1", 5, "1M", "X", 3, 60)] * 1 + [("s", "1", 19, "1M", "A", 3, 60)] * 12 + [("s", "1", 19, "1M", "T", 3, 60)] * 11
    df = ase.allele_specific_expression(genes, sites, aligned(spark, reads), min_hets=2, min_coverage=10, q=0.5, mode="standard")
    rows = {r.gene_id: r for r in df.collect()}
    assert set(rows) == {"g1", "g2"} and rows["g1"].gene_name == "ONE"
    r, g = rows["g1"], lambda a, b: 2 * (a * math.log(2 * a / (a + b)) + b * math.log(2 * b / (a + b)))
    assert (r.locus, r.hetSites, r.highCount, r.lowCount, r.highHap, r.lowHap, r.positions) == ("1:1-10", 2, 55, 3, "0/1", "1/.", "3/6")
    assert r.highFrac == pytest.approx(55 / 58) and r.meanCount == 29 and r.sdCount == 3
    assert r.pValue == pytest.approx(math.exp(-(g(30, 2) + g(25, 1)) / 2) * 1, rel=1e-9)
    strict = ase.allele_specific_expression(genes, sites, aligned(spark, reads), min_hets=2, q=0.5)
    assert [x.gene_id for x in strict.collect()] == ["g2"] or [x.gene_id for x in strict.collect()] == []  # the best gene has rank 0
    assert [x.gene_id for x in ase.allele_specific_expression(genes, sites, aligned(spark, reads), min_hets=3, q=1.0, mode="standard").collect()] == []


def test_repeated_sites_count_twice(spark):
    genes = spark.createDataFrame([("1", 1, 10, "g", "G")], "chrom string, lo long, hi long, gene_id string, gene_name string")
    sites = spark.createDataFrame([("1", 3, 0, ["A", "C"]), ("1", 3, 1, ["A", "G"])], "chrom string, pos long, ord long, alleles array<string>")
    rows = ase.gene_sites(genes, sites).collect()
    assert len(rows) == 2 and rows[0].alleles == ["A", "C", "G"]


def test_pileup_and_indels(spark):
    df = aligned(spark, [("s", "1", 5, "2M1I1M2D1M", "ACGTT", 0, 60), ("s", "1", 5, "2M", "Au", 0, 60), ("s", "1", 5, "1M", "A", 4, 10), ("s", "1", 5, "1M", "n", 4, 60)])
    got = {(r.pos, r.symbol): r.n for r in pileup.pileup(df).collect()}
    assert got == {(5, "A"): 2, (5, "N"): 1, (6, "C"): 1, (6, "T"): 1, (7, "+G"): 1, (7, "T"): 1, (8, "-2"): 1, (10, "T"): 1}
    assert {(r.pos, r.indels) for r in pileup.divergences(pileup.pileup(df)).collect()} == {(5, "."), (6, "."), (7, "+G:1"), (8, "-2:1"), (10, ".")}


def test_divergence(spark):
    rows = []
    for pos in range(3, 23):
        for i in range(5):
            odd = pos == 10 and i == 0
            rows += [(f"s{i}", "1", pos, "G" if odd else "A", 100), (f"s{i}", "1", pos, "C", 2 + (pos + i) % 3)]
    symbols = spark.createDataFrame(rows, "sample string, chrom string, pos long, symbol string, n long")
    reference = spark.createDataFrame([("1", "A" * 30)], "name string, seq string")
    table, models = divergence.divergence(symbols, reference, coverage=10)
    model = models.first()
    assert model.context == "AAAAAA" and 90 <= model.gamma_n <= 100
    q = {"A": 400 / (500 + 2 + 3 + 4 + 2 + 3 + 0.0), "G": 0}
    places = pileup.divergences(symbols).where("pos = 10 AND sample = 's0'").first()
    pool, own = {"A": 400, "G": 100, "C": sum(2 + (10 + i) % 3 for i in range(5))}, {"G": 100, "C": 2 + 10 % 3}
    total, mine = sum(pool.values()), sum(own.values())
    assert places.kld == pytest.approx(sum(n / mine * math.log(n / mine / (pool[s] / total)) for s, n in own.items()))
    assert (places.total, places.pool_total, places.pool_alleles, places.G) == (mine, total, 3, 100) and q
    got = divergence.significant(divergence.context(pileup.divergences(symbols), reference), models, 10, most_p=0.02, most_fit=1.0).collect()
    assert [(r.locus, r.sample) for r in got] == [("1:11", "s0")] and got[0].gt == "hom"
    with pytest.raises(Exception, match="no model of context"):
        divergence.significant(divergence.context(pileup.divergences(symbols), reference), models.where("false"), 10).collect()
    regions = spark.createDataFrame([("1", 0, 5)], "chrom string, start long, stop long")
    assert divergence.divergence(symbols, reference, regions=regions)[1].first().gamma_n <= 10
    assert table.columns[0] == "locus" and len(table.columns) == 16


def test_depletion(spark):
    ref = "ACGTTGCATGCCATAGGTCAATCGGATTACAGG"
    back = ref[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pairs = spark.createDataFrame([(0, "TT" + ref[3:30], "A" * 40), (1, "A" * 40, back), (2, "A" * 40, "C" * 40), (3, "ACG", None)], "read_no long, seq_1 string, seq_2 string")
    kept, tossed = depletion.deplete(pairs, spark.createDataFrame([(ref,)], "seq string"))
    assert {r.read_no for r in kept.collect()} == {2, 3} and {r.read_no for r in tossed.collect()} == {0, 1}
    assert {(r.hit, r.n, r.percent) for r in depletion.counts(pairs, spark.createDataFrame([(ref,)], "seq string")).collect()} == {(True, 2, 50.0), (False, 2, 50.0)}
    none = depletion.deplete(pairs, spark.createDataFrame([(ref,)], "seq string"), probability=1e-9)[1]
    assert none.count() == 0


def test_bait_scan(spark):
    bait = "ACGTTGCATGCCATAGGTCAATCGGATTAC"
    genome = spark.createDataFrame([("c", "GG" + bait + "NNN" + bait[::-1].translate(str.maketrans("ACGT", "TGCA")) + "T")], "name string, seq string")
    got = {tuple(r) for r in bait_scan.bait_hits(genome, spark.createDataFrame([("b", bait)], "name string, seq string")).collect()}
    assert got == {("c", 2, 31, "b"), ("c", 35, 64, "b")}


def test_kmer_bias(spark):
    pairs = spark.createDataFrame([("s", "ACGT", "AAN"), ("s", "ACNT", None), ("t", "GG", "A")], "sample string, seq_1 string, seq_2 string")
    counts = kmer_bias.kmer_cycle_counts(pairs, 2)
    got = {(r.sample, r.read, r.strand, r.pos, r.k, r.n) for r in counts.withColumn("k", decode(F.col("kmer"), 2)).collect()}
    assert {g for g in got if g[1:3] == ("read1", "fwd")} == {("s", "read1", "fwd", 0, "AC", 2), ("s", "read1", "fwd", 1, "CG", 1), ("s", "read1", "fwd", 2, "GT", 1), ("t", "read1", "fwd", 0, "GG", 1)}
    assert ("s", "read2", "rev", 0, "TT", 1) in got and ("s", "read1", "rev", 0, "GT", 2) in got
    twice = kmer_bias.merge_counts(counts, counts)
    assert {r.n for r in twice.where("sample = 't'").collect()} == {2}
    with pytest.raises(Exception, match="mismatched"):
        kmer_bias.merge_counts(counts, counts.withColumn("K", F.lit(3))).collect()
    overall = {r.kmer: r.p for r in kmer_bias.global_distribution(counts).collect()}
    assert sum(overall.values()) == pytest.approx(1.0)
    kld = {(r.sample, r.read, r.pos): r.kld for r in kmer_bias.against_global(counts, kmer_bias.global_distribution(counts)).collect()}
    assert kld["s", "read1", 0] == pytest.approx(math.log(1 / overall[1]))
    scored = kmer_bias.score_sample(counts).collect()
    assert len(scored) == len(kld) and all(r.pval is None or 0 <= r.pval <= 1 for r in scored)
    assert len(kmer_bias.score_samples(counts).collect()) == len(kld)


def test_strings(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = F.lit
    assert one(st.first_word(lit("a b c")), st.words(lit(" a  b")), st.options(lit("a,,b")), st.after_last(lit("x/y/z")), st.sample_label(lit("d/run_1_.-"))) == ("a", ["a", "b"], ["a", "", "b"], "z", "run_1")
    prefix = lambda *xs: one(st.common_prefix(F.array(*map(lit, xs))))[0]
    assert (prefix("run_1.fq", "run_2.fq"), prefix("a"), prefix("b", "a"), prefix("ab", "abc")) == ("run_", "a", "", "ab")
    assert one(st.trimmed(lit(" \tx \n")), st.right_trimmed(lit(" x \n")), st.haplotypes(F.array(lit(0), lit(-1), lit(2))), st.locus(lit("c"), lit(4)), st.locus(lit("c"), lit(4), lit(9))) == ("x", " x", "0/./2", "c:5", "c:4-9")
    assert one(*(st.symbol(lit(b)) for b in "aUGnR")) == ("A", "T", "G", "N", "N")
    names = ["chr10", "2", "chrX", "Y", "chrM", "GL1", "chr1"]
    assert [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(st.karyotype_rank(F.col("n")), "n").collect()] == ["chr1", "2", "chr10", "chrX", "Y", "chrM", "GL1"]
    assert one(chi2_tail(lit(2.0), lit(2)))[0] == pytest.approx(math.exp(-1))


def plain_walk(pos0, ops, seq, emit):
    """What one read shows, one base after the other."""
    if pos0 is None or ops is None:
        return
    ref, at = pos0, 0
    base = lambda i: None if seq is None else seq[i : i + 1]
    named = lambda b: {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T"}.get((b or "").upper(), "N") if emit == "pileup" else b
    for op, n in ops:
        for i in range(n):
            if op in "M=X" or op == "D" and emit == "depth":
                yield ref + i, None if emit == "depth" else named(base(at + i))
        if n and op == "I" and emit != "depth":
            yield ref, None if seq is None else ("+" if emit == "pileup" else "") + seq[at : at + n]
        if n and op == "D" and emit == "pileup":
            yield ref, f"-{n}"
        ref, at = ref + n * (op in "M=XDN"), at + n * (op in "M=XIS")


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_cigar_kernel_equals_plain_walk(spark, monkeypatch, most):
    """Reads of every kind, whatever the slices: null and short sequences, null places and CIGARs, empty operations, odd letters."""
    monkeypatch.setattr(cigar, "SHOWN", most)
    r = random.Random(most)
    rows = []
    for i in range(300):
        ops = [(r.choice("MIDNSHP=X"), r.choice([0, 1, 2, 5, 9])) for _ in range(r.randint(0, 6))]
        seq = r.choice([None, "", "".join(r.choice("ACGTUNacgtn*é") for _ in range(r.randint(1, 30)))])
        rows.append((r.choice([None, "s1", "s2"]), r.choice(["c1", "c2", None]), r.choice([None, 0, 3, 10**12]) if i % 9 == 0 else r.randint(0, 20), None if i % 31 == 0 else ops, seq))
    rows.append(("s1", "c1", 5, [("M", 5_000), ("N", 10**8), ("D", 3), ("M", 1)], "ACGT" * 1_300))
    df = spark.createDataFrame(rows, "sample string, chrom string, pos0 long, cigar array<struct<op:string,len:int>>, seq string").repartition(3)
    for emit in cigar.EMITS:
        shown = [(s, c, *x) for s, c, p, ops, seq in rows for x in plain_walk(p, ops, seq and seq.replace("é", "?"), emit)]
        assert Counter(map(tuple, cigar.explode_cigar(df, emit).collect())) == Counter(shown)
        got = cigar.counted(df, emit, ["sample", "chrom"]).collect()
        assert {tuple(x[:4]): x.n for x in got} == Counter(shown) and len(got) == len(set(shown))
        texts = df.withColumn("cigar", F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), ""))
        assert Counter(map(tuple, cigar.explode_cigar(texts, emit).collect())) == Counter(shown)
    odd = [("c", 0, t, "ACGTACGT") for t in ("2M3", "*", "", "2M3Q1M", "M2M", "12", "0M1M")]
    got = cigar.explode_cigar(spark.createDataFrame(odd, "chrom string, pos0 long, cigar string, seq string").coalesce(1), "depth")
    assert got.count() == 2 + 3 + 2 + 1
    with pytest.raises(ValueError):
        cigar.counted(df, "bases", [])
    assert cigar.counted(df.limit(0), "pileup", ["chrom"]).count() == 0


def test_cigar_texts(spark):
    texts = ["1S3M2I", "*", "", "12M", None, "3M2Q", "M3"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select(cigar.parse_cigar(F.col("c")).alias("x"))
    assert [None if r.x is None else [tuple(o) for o in r.x] for r in df.collect()] == [[("S", 1), ("M", 3), ("I", 2)], [], [], [("M", 12)], None, [("M", 3)], []]


def test_distributions_as_json(spark):
    """There and back: every share at its place in dense arrays, the global one beside them."""
    pairs = spark.createDataFrame([("s", "ACGT", "AAN"), ("s", "ACNT", None), ("t", "GG", "A")], "sample string, seq_1 string, seq_2 string")
    counts = kmer_bias.kmer_cycle_counts(pairs, 2)
    shares, overall = kmer_bias.distributions(counts), kmer_bias.global_distribution(counts)
    docs = {r["sample"]: json.loads(r.value) for r in sinks.distributions_json(shares, overall, 2).collect()}
    assert set(docs) == {"s", "t"} and docs["s"]["K"] == 2
    want = {r.kmer: r.p for r in overall.collect()}
    assert docs["s"]["global"] == pytest.approx([want.get(i, 0) for i in range(16)])
    for r in shares.collect():
        assert docs[r["sample"]][r.read][r.strand][r.pos][r.kmer] == pytest.approx(r.p)
    assert sum(docs["s"]["read1"]["fwd"][0]) == pytest.approx(1)


def test_parts_of_a_pileup_equal_the_whole(spark):
    """Indels and places that are made alone, without the bases, are those of the whole pileup; sites are chosen before the sum."""
    rows = [("s", 2, "c", 5, 60, "3M2I1M2D2M", "ACGTTUNA"), ("s", 2, "c", 6, 60, "1S4M", "ACGTA"), ("t", 4, "c", 7, 10, "4M", "ACGT"), ("t", 2, "d", 5, 60, "2M1N2I1D", "AC"), ("t", 2, "d", None, 60, "2M", "AC"), ("t", 2, "d", 3, 60, "2M1I", None)]
    reads = spark.createDataFrame(rows, "sample string, flag int, chrom string, pos0 long, mapq int, cigar string, seq string")
    whole = pileup.pileup(reads)
    indels = [tuple(r) for r in whole.where("symbol rlike '^[+-]'").collect()]
    assert len(indels) == 3 + 1 and sorted(indels) == sorted(tuple(r) for r in pileup.indel_symbols(reads).where("symbol is not null").collect())
    assert sorted(whole.select("chrom", "pos").distinct().collect()) == sorted(pileup.places(reads).collect())
    plan = ase.allele_counts(reads, spark.createDataFrame([("c", 7), ("c", 7), ("d", 99)], "chrom string, pos long"))
    assert [(r.chrom, r.pos, r.allele, r.n) for r in plan.collect()] == [("c", 7, "C", 2)]


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
def test_stretches_merge_in_any_slices(monkeypatch, most):
    """Counts of stretches that come in many rows and batches, one stretch in most of them, are those of all rows together."""
    monkeypatch.setattr(cigar, "SHOWN", most)
    r = random.Random(most)
    texts, rows = ["+A", "-12", "T", ""], []
    for _ in range(60):
        places = sorted((r.choice([-3, 5, 6, 7, 5_000_000_000]), r.choice([65, 84, 256, 257, 258, 259, 260])) for _ in range(r.randint(1, 9)))
        rows.append((r.choice([None, "a", "b"]), places))
    whole, parts = Counter(), []
    for key, shown in rows:
        group, places, names, n = cigar._summed(np.zeros(len(shown), np.int64), *(np.array(x, np.int64) for x in zip(*shown, strict=True)), cigar.ABSENT + 1 + len(texts))
        parts.append(pa.RecordBatch.from_arrays(cigar.packed([pa.array([key], pa.string())], group, places, names, n, pa.array(texts)), names=["k", "b", "e", "t"]))
        whole.update((key, p, None if c == 256 else chr(c) if c < 256 else texts[c - 257]) for p, c in shown)  # one letter as a text too
    table = pa.Table.from_batches(parts).sort_by([("k", "ascending"), ("b", "ascending")])
    batches = table.combine_chunks().to_batches(max_chunksize=7)
    got = [x for b in cigar._merged(batches, 1, ["k", "pos", "allele", "n"]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {x[:3]: x[3] for x in got} == whole and len(got) == len(whole)


def test_counts_are_shuffled_by_stretch(spark):
    """Two hundred reads of one stretch are a row for each task of the shuffle, not one for each base that is shown."""
    rows = [("s", 2, "c", 5 + i % 100, 60, "3M2I1M2D2M", "ACGTTUNA") for i in range(200)]
    reads = spark.createDataFrame(rows, "sample string, flag int, chrom string, pos0 long, mapq int, cigar string, seq string").coalesce(1)
    piled = pileup.pileup(reads)
    assert piled.agg(F.sum("n")).first()[0] == 200 * 8
    plan = piled._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "_entries" in plan
    assert [r.n for r in piled.where("pos = 8 and symbol like '+%'").collect()] == [2]
