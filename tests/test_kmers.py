import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmers as km
from strandloom.operators import kmers, minimizers
from strandloom.streaming.kmer_counts import stream_spectrum, stream_windowed

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def oracle(seq, k):
    seq = (seq or "").upper()
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            yield i, w, w[::-1].translate(COMPLEMENT)


def number(w):
    return sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))


@pytest.fixture(scope="module")
def sequences(spark):
    r = random.Random(7)
    rows = [(i, "".join(r.choice("ACGTacgtACGTACGTN-ßU") for _ in range(r.randint(0, 80)))) for i in range(60)] + [(60, None), (61, ""), (62, "A" * 200_000)]
    return rows, spark.createDataFrame(rows, "id long, seq string")


@pytest.mark.parametrize("k", [1, 2, 5, 31])
def test_positions_and_strands(sequences, k):
    rows, df = sequences
    rows = [(i, s) for i, s in rows if i < 62]
    got = {(r.id, r.pos, r.kmer, r.rc, r.rc_pos) for r in kmers.kmers(df.where("id < 62"), "seq", k, positions=True, both_strands=True).collect()}
    assert got == {(i, p, number(w), number(rc), len(s) - k - p) for i, s in rows for p, w, rc in oracle((s or "").replace("ß", "N"), k)}


def test_long_sequence_and_canonical(sequences):
    _, df = sequences
    assert [tuple(r) for r in kmers.spectrum(df.where("id = 62"), "seq", 9).collect()] == [(0, 200_000 - 8)]
    rows = [(r.kmer,) for r in kmers.kmers(df.where("id < 60"), "seq", 4, canonical=True).select("kmer").collect()]
    want = [min(number(w), number(rc)) for i, s in sequences[0][:60] for _, w, rc in oracle(s.replace("ß", "N"), 4)]
    assert sorted(r[0] for r in rows) == sorted(want)


def test_columns(spark, sequences):
    rows, df = sequences
    short = df.where("id < 62")
    got = sorted((r.id, r.k) for r in short.select("id", F.explode(km.kmer_array(F.col("seq"), 3)).alias("k")).collect())
    assert got == sorted((i, w) for i, s in rows if i < 62 for _, w, _ in oracle((s or "").replace("ß", "N"), 3))
    got = sorted((r.id, r.w.pos, r.w.kmer) for r in short.select("id", F.explode(km.windows(F.col("seq"), 3)).alias("w")).collect())
    assert got == sorted((i, p, w) for i, s in rows if i < 62 for p, w, _ in oracle((s or "").replace("ß", "N"), 3))
    one = spark.sql("SELECT 'GATTACA' a, 'NAC' b, 'acg' c, 'U' d, 'TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT' e")
    r = one.select(km.encode(F.col("a")), km.decode(km.encode(F.col("a")), 7), km.encode(F.col("b")), km.reverse_complement(F.col("c")), km.canonical(F.col("a")), km.base_code(F.lit("t")), km.base_code(F.col("d")), km.encode(F.col("e"))).first()
    assert tuple(r) == (number("GATTACA"), "GATTACA", 0, "CGT", "GATTACA", 3, None, 4**31 - 1)
    assert one.select(km.hamming(km.encode(F.lit("GATTACA")), km.encode(F.lit("GACTATA")))).first()[0] == 2
    assert abs(one.select(km.entropy(F.lit("ACGTACGT"), 8, 1)).first()[0] - 2.0) < 1e-12


def test_k_is_checked(sequences):
    for k in (0, 32):
        with pytest.raises(ValueError):
            kmers.kmers(sequences[1], "seq", k)


def test_sets(spark):
    r = random.Random(19)
    members, probes = {r.randrange(4**8) for _ in range(100)}, [r.randrange(4**8) for _ in range(100)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "kmer long")
    some = frame([*members, *list(members)[:10], None])
    assert {(x.kmer, x.found) for x in kmers.contains(frame([*probes, *list(members)[:5]]), some).collect()} == {(p, p in members) for p in [*probes, *list(members)[:5]]}
    assert {(x.kmer, x.rank) for x in kmers.ranked(some).collect()} == {(m, i) for i, m in enumerate(sorted(members))}
    assert kmers.select_rank(some, 3).first().kmer == sorted(members)[3] and kmers.select_rank(some, 1000).count() == 0
    assert {x.kmer for x in kmers.disjoint_union(frame([1, 2]), frame([3])).collect()} == {1, 2, 3}
    with pytest.raises(Exception, match="both sets hold 2"):
        kmers.disjoint_union(frame([1, 2]), frame([2])).collect()


def test_annotations_are_united_by_or(spark):
    df = spark.createDataFrame([(5, 1), (6, 1), (1, 1), (2, 1), (5, 2), (2, 2), (3, 1)], "kmer long, mask long")
    assert {tuple(r) for r in kmers.annotate(df).collect()} == {(1, 1), (2, 3), (3, 1), (5, 3), (6, 1)}


def test_sampling(spark):
    df = spark.range(20_000)
    some = {r.id for r in kmers.sampled(df, 3, 0.25, "id").collect()}
    assert 4_500 < len(some) < 5_500 and some == {r.id for r in kmers.sampled(df.repartition(7), 3, 0.25, "id").collect()}
    assert some != {r.id for r in kmers.sampled(df, 4, 0.25, "id").collect()} and kmers.sampled(df, 3, 1.0).count() == 20_000
    assert kmers.seed_and_probability("17.25") == (17, 0.25) and kmers.seed_and_probability("1.0") == (1, 1.0)


def test_stream_equals_batch(spark, tmp_path):
    reads = spark.createDataFrame([("ACGTACGT",), ("GGGNACG",)], "seq string")
    reads.write.parquet(str(tmp_path / "in"))
    q = stream_spectrum(spark.readStream.schema("seq string").parquet(str(tmp_path / "in")), "seq", 3).writeStream.outputMode("complete").format("memory").queryName("spectrum").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("spectrum").collect()} == {tuple(r) for r in kmers.spectrum(reads, "seq", 3).collect()}


def bases_with_repeats(r, n):
    """Random bases with runs of one base and letters that are none."""
    return "".join(r.choice(["ACGT"[r.randrange(4)] * 1] * 30 + ["A" * 60, "N", "acgt"]) for _ in range(n))


@pytest.mark.parametrize("k,crowded", [(25, 4), (25, 0), (11, 4), (5, 4)])
def test_minimizers_find_what_a_join_finds(spark, monkeypatch, k, crowded):
    """Super-k-mers against a join of all k-mers, with and without buckets that are split."""
    monkeypatch.setattr(minimizers, "CROWDED", crowded)
    r = random.Random(k)
    texts = [bases_with_repeats(r, r.choice([0, 3, 40, 400])) for _ in range(60)] + [None, "A" * 3_000, "ACGT" * 500]
    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"s{i}", t) for i, t in enumerate(texts)] * 3, "id int, name string, seq string").repartition(3)
    every = kmers.kmers(rows, "seq", k, positions=True)
    members = every.select("kmer").distinct().where("pmod(kmer, 3) = 0").unionByName(spark.createDataFrame([(5,), (None,)], "kmer long")).distinct()
    want = Counter(map(tuple, every.join(members, "kmer", "left_semi").select("id", "name", "kmer", "pos").collect()))
    assert Counter(map(tuple, minimizers.looked_up(rows, "seq", k, members, positions=True).collect())) == want and want
    few = Counter(map(tuple, kmers.kmers_among(rows, "seq", k, members, positions=True, most=3).collect()))
    assert few == want
    assert minimizers.looked_up(rows, "seq", k, members.where("false")).count() == 0
    assert minimizers.looked_up(rows.where("false"), "seq", k, members).count() == 0


def shuffled(spark, df, first=[0]):  # noqa: B006  (the first stage that was not asked for yet)
    """Bytes that a query writes for its shuffles."""
    df.write.format("noop").mode("overwrite").save()
    store, total = spark.sparkContext._jsc.sc().statusStore(), 0
    for stage in range(first[0], first[0] + 1_000):
        try:
            total += store.lastStageAttempt(stage).shuffleWriteBytes()
            first[0] = stage + 1
        except Exception:
            continue
    return total


def test_super_kmers_move_less_than_kmers(spark):
    """Shuffled bytes for K = 25 on random bases, which nothing compresses, are below 2/7 of those of a join of all k-mers."""
    r = random.Random(1)
    rows = spark.createDataFrame([(i, "".join(r.choices("ACGT", k=4_000))) for i in range(150)], "id long, seq string")
    members = kmers.kmers(rows.where("id = 3").select("seq"), "seq", 25).distinct()
    shuffled(spark, spark.range(1))  # what earlier queries have written
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = shuffled(spark, kmers.kmers(rows, "seq", 25).join(members, "kmer", "left_semi"))
        pieces = shuffled(spark, minimizers.looked_up(rows, "seq", 25, members))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < pieces * 3.5 <= plain


def test_windowed_counts_of_a_stream(spark, tmp_path):
    """Counts by event time; what is late beyond the watermark is given up, and closed windows come out once."""
    reads = [[("2024-01-01 00:00:10", "ACGT"), ("2024-01-01 00:00:50", "ACGA"), ("2024-01-01 00:01:10", "ACGT")], [("2024-01-01 00:09:00", "TTTT")], [("2024-01-01 00:10:00", "NNN")], [("2024-01-01 00:00:20", "ACGT"), ("2024-01-01 00:20:00", None)]]
    schema = "time timestamp, seq string"
    for i, rows in enumerate(reads):
        spark.createDataFrame(rows, "t string, seq string").select(F.to_timestamp("t").alias("time"), "seq").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    counts = stream_windowed(stream, "seq", 3, "time", "1 minute", "2 minutes")
    query = counts.writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = {(r.window.start.minute, km_text(r.kmer)): r.n for r in spark.table("windowed").collect()}
    assert got[0, "ACG"] == 3 and got[0, "CGA"] == 1 and got[1, "ACG"] == 2  # CGT is counted as ACG
    assert got[9, "AAA"] == 2 and spark.table("windowed").count() == len(got)


def km_text(code):
    return "".join("ACGT"[code >> 2 * i & 3] for i in (2, 1, 0))


def test_counted_kmers_equal_counts_of_rows(spark):
    """Whole sequences with whatever letters, by key and place, for codes that fill a table and for those that do not."""
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), "".join(r.choices("ACGTacgtNé€", k=r.choice([0, 2, 3, 40])))) for _ in range(200)] + [("a", None), ("b", "")]
    df = spark.createDataFrame(rows, "name string, seq string").repartition(3)
    for k in (2, 3, 31):
        want = kmers.kmers(df, "seq", k, positions=True, both_strands=True).groupBy("name", "pos", "kmer", "rc").count()
        got = kmers.counted(df, "seq", k)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.select("name", "pos", "kmer", "rc", "count").collect())))


def test_counted_kmers_of_consecutive_reads(monkeypatch):
    """Texts are cut into reads after what is no letter is left out, and a batch gives a row for each cell, at any size of slices."""
    texts = ["ab-cd éa b c d abcd" * 9, "", None, "--", "abc"]
    table = kmers.letter_codes("abcd", "ACGT")
    bare = ["".join(c for c in t or "" if c in "abcd") for t in texts]
    want = Counter()
    for at, text in enumerate(bare):
        for i in range(0, len(text), 5):
            read = text[i : i + 5]
            want.update((at % 2, i // 5 % 2 == 1, p, sum("abcd".index(c) * 4 ** (2 - j) for j, c in enumerate(read[p : p + 3]))) for p in range(len(read) - 2))
    group = np.arange(len(texts)) % 2
    for windows, cells in ((1 << 20, 1 << 22), (7, 1 << 22), (7, 0)):
        monkeypatch.setattr(kmers, "WINDOWS", windows)
        monkeypatch.setattr(kmers, "CELLS", cells)
        got, slices = Counter(), 0
        for columns in kmers._tallies(pa.array(texts), group, 2, 3, 5, table):
            slices += 1
            for *cell, n in zip(*(c.tolist() for c in columns), strict=True):
                got[tuple(cell)] += n
        assert got == want and (slices == 1) == (windows > 7)
