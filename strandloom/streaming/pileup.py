"""The pileup of a stream of reads that are sorted by place within each sample and chromosome."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandloom.operators import cigar

#: The place of a row that ends its sample and chromosome: all that is still open there is given out.
END = 1 << 62
COUNTS = "sample string, chrom string, pos long, symbol string, n long"


def batch_pileups(reads: DataFrame) -> DataFrame:
    """COUNTS of each Arrow batch by itself, and rows with n = 0 at the first and last start of its reads."""
    kernel = cigar.batch_counts(2)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = pa.Table.from_batches([batch]).group_by(["sample", "chrom"]).aggregate([("pos0", "min"), ("pos0", "max")])
            for place in ("pos0_min", "pos0_max"):
                none = pa.nulls(len(starts), pa.string())
                columns = [starts["sample"].combine_chunks(), starts["chrom"].combine_chunks(), starts[place].combine_chunks(), none, pa.array(np.zeros(len(starts), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            for columns in cigar.walked(batch, "pileup", kernel):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return reads.select("sample", "chrom", F.col("pos0").cast("long"), "cigar", "seq").mapInArrow(run, COUNTS)


class OpenPlaces(StatefulProcessor):
    """Counts of the places that a later read can still reach, and the last start seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start long, pos array<long>, symbol array<string>, n array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        start, *held = self.open.get() if self.open.exists() else (-1, [], [], [])
        parts = [pd.DataFrame({"pos": list(held[0]), "symbol": list(held[1]), "n": list(held[2])}).astype({"pos": "int64", "n": "int64"})]
        first, last = END, start
        for part in rows:
            marks = part["pos"][part["n"] == 0]
            if len(marks):
                first, last = min(first, marks.min()), max(last, marks.max())
            parts.append(self.summed([part.loc[part["n"] > 0, ["pos", "symbol", "n"]]]))
        if first < start:
            raise ValueError(f"reads of {key} are not sorted: one starts at {first}, after {start} was seen")
        every = self.summed(parts)
        done = every["pos"] < last
        if last >= END:
            self.open.clear()
        else:
            left = every[~done]
            self.open.update((int(last), left["pos"].tolist(), [None if pd.isna(s) else s for s in left["symbol"]], left["n"].tolist()))
        out = every[done]
        yield pd.DataFrame({"sample": key[0], "chrom": key[1], "pos": out["pos"], "symbol": out["symbol"], "n": out["n"]})

    @staticmethod
    def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["pos", "symbol"], dropna=False, as_index=False)["n"].sum()

    def close(self) -> None:
        pass


def stream_pileup(alignments: DataFrame, mapq_of_unmapped: int = 55) -> DataFrame:
    """sample, chrom, pos, symbol, n as ``operators.pileup.pileup`` has them, of a streaming DataFrame, for the output mode append.

    Reads of a later micro-batch must not start before one of an earlier batch of the same sample and chromosome; one
    that does raises ValueError. A place is given out once a read starts behind it, so the state of a sample and
    chromosome spans one read; a row with pos0 = ``END`` gives out the rest. Each batch is counted before it is
    shuffled, and a task holds the counted places of one micro-batch of its samples and chromosomes: bound that by the
    source's rate. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    bad = (F.col("flag").bitwiseAND(F.lit(cigar.UNMAPPED)) != 0) & (F.col("mapq") < mapq_of_unmapped)
    kept = alignments.where(F.col("pos0").isNotNull() & (~bad | (F.col("pos0") == END)))
    places = batch_pileups(kept).groupBy("sample", "chrom")
    return places.transformWithStateInPandas(OpenPlaces(), COUNTS, "append", "none")
