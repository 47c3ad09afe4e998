"""The pileup of a sorted stream against that of all reads at once."""

import random
from itertools import count

import pytest

from strandloom.operators.pileup import pileup
from strandloom.streaming.pileup import END, stream_pileup

SCHEMA = "sample string, chrom string, pos0 long, cigar string, seq string, flag int, mapq int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reads(n, seed):
    rng = random.Random(seed)
    at = {}
    for _ in range(n):
        key = rng.choice(["s1", "s2", None]), rng.choice(["c1", "c1", "c1", "c2"])
        at[key] = at.get(key, 0) + rng.choice([0, 0, 1, 3, 40])
        cigar, size = rng.choice([("10M", 10), ("2S4M2I2M", 10), ("3M4D3M", 6), ("4M9N4M", 8), ("5M", 3), ("*", 4)])
        yield (*key, at[key], cigar, rng.choice([None, "".join(rng.choices("ACGTN", k=size))]) if rng.random() < 0.1 else "".join(rng.choices("ACGTN", k=size)), rng.choice([0, 4, 2]), rng.choice([0, 60]))


@pytest.fixture
def streamed(spark, tmp_path):
    numbers = count()

    def run(batches):
        for rows in batches:  # each is a run of the stream, which goes on from its checkpoint
            spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / f"in/{next(numbers)}"))
            q = (
                stream_pileup(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
                .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
                .outputMode("append").trigger(availableNow=True).start()
            )
            q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    yield run
    spark.conf.set(STORE, before)


def test_stream_equals_batch(spark, streamed):
    rows = list(reads(600, 1))
    ends = [(s, c, END, None, None, None, None) for s in ("s1", "s2", None) for c in ("c1", "c2")]
    got = streamed([rows[:250], rows[250:260], rows[260:], ends])
    want = pileup(spark.createDataFrame(rows, SCHEMA)).select("sample", "chrom", "pos", "symbol", "n").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r)) for r in want) and len(want) > 1_000


def test_only_places_behind_the_last_start_are_out(spark, streamed):
    got = streamed([[("s", "c", 0, "4M", "ACGT", 0, 60), ("s", "c", 2, "4M", "ACGT", 0, 60)], [("s", "c", 3, "4M", "TTTT", 0, 60)]])
    assert {(r.pos, r.symbol, r.n) for r in got} == {(0, "A", 1), (1, "C", 1), (2, "G", 1), (2, "A", 1)}
    with pytest.raises(Exception, match="not sorted"):
        streamed([[("s", "c", 1, "4M", "ACGT", 0, 60)]])
