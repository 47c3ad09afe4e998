"""PCA whitening of embeddings over an exact scatter matrix, by residue numbers.

Entries become integers, x = floor(scale * c) + shift. The fit list is every distinct x vector once. With its size n and
the sums S of each dimension, z = n x - S are centred integers, and Z, the sum of z z', is n^3 times the covariance V.
Z outgrows 64 bits, so it is made modulo several primes: a task reduces its z modulo each prime and multiplies blocks
of rows as doubles, which hold every sum exactly, as ROWS rows of products below 2^40 stay below 2^53. The sums of the
tasks meet by row of the matrix, where the Chinese remainder theorem gives the integers back; how many primes that
takes is known beforehand from n and the range of each dimension. Z / n^3 is rounded once, to a double, and ``eigh``
decomposes it on the driver, whose share is a d x d matrix with d bounded by MOST_DIMENSIONS.

Vectors that are null, empty or hold a null or non-finite entry take no part. A scaled entry beyond 2^62 is
set to that.
Vectors of unlike lengths are separate spaces, each with a fit of its own (at most MOST_LENGTHS, else an error).
Components whose eigenvalue is not positive to double precision are left out, so vectors that are all equal give no
rows. Each component has the sign that makes its largest entry positive. Repeated rows and ids are all answered, ids
may be null, other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut, small_batches

#: Residues are below 2^20, so the products of 2^13 rows are summed exactly in doubles.
PRIME_BELOW, ROWS = 1 << 20, 1 << 13
MOST_DIMENSIONS, MOST_LENGTHS = 2_048, 16
#: An integer beyond this is set to it, before the shift.
END = 2.0**62
#: Integers of a task in 64 bits as long as nothing can reach this.
SAFE = 1 << 62


def primes(product: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds a number."""
    found, p, reached = [], PRIME_BELOW, 1
    while reached <= product:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            reached *= p
    return found


def from_residues(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """The integers of least magnitude with these residues (one row for each modulus), by Garner's mixed radix."""
    digits, product = [], 1
    values = [0] * residues.shape[1]
    for row, p in zip(residues, moduli, strict=True):
        inverse = pow(product % p, -1, p)
        digits = [(int(r) - v) * inverse % p for r, v in zip(row, values, strict=True)]
        values = [v + product * d for v, d in zip(values, digits, strict=True)]
        product *= p
    return [v if 2 * v < product else v - product for v in values]


@dataclass
class Fit:
    """What the fit list of one length of vectors gives, and its whitening."""

    n: int
    sums: list[int]
    reach: int  # no entry of z is larger
    moduli: list[int]
    components: np.ndarray | None = None  # one row for each
    roots: np.ndarray | None = None
    explained: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as Python's integers where 64 bits may not hold it."""
        if self.reach * 2 < SAFE and self.n * int(np.abs(x).max(initial=0)) < SAFE:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(float) / self.n) @ self.components.T / self.roots


def integers(df: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """id, d, x (d little-endian 64-bit integers) of the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            d = held.value_lengths().to_numpy().astype(np.int64)
            y = np.floor(held.flatten().to_numpy() * scale)
            x = np.clip(y, -END, END).astype(np.int64) + shift
            data, cuts = x.astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(d))) * 8
            packed = [data[f:t] for f, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), pa.array(packed, pa.binary())], names=["id", "d", "x"])

    return rows.mapInArrow(run, "id long, d long, x binary")


def by_length(batch: pa.RecordBatch, d_at: int, x_at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, matrix of x) for each length of vectors."""
    lengths, packed = batch.column(d_at).to_numpy(), batch.column(x_at)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        own = packed if len(at) == len(packed) else packed.take(pa.array(at))
        yield int(d), at, np.frombuffer(b"".join(own.to_pylist()), "<i8").reshape(len(at), int(d))


def sums(fit_list: DataFrame) -> dict[int, Fit]:
    """n, S and the reach of z for each length. A task gives one row a dimension; their sums are exact decimals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, _, x in by_length(batch, 0, 1):
                # Halves of 32 bits, so that sums of any number of rows stay exact.
                parts = [len(x), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0)]
                old = held.get(d)
                held[d] = parts if old is None else [old[0] + parts[0], old[1] + parts[1], old[2] + parts[2], np.minimum(old[3], parts[3]), np.maximum(old[4], parts[4])]
        for d, (n, high, low, least, most) in held.items():
            columns = [np.full(d, d), np.arange(d), np.full(d, n), high, low, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d", "i", "n", "high", "low", "least", "most"])

    rows = fit_list.select("d", "x").mapInArrow(run, "d long, i long, n long, high long, low long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    total = rows.groupBy("d", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most"))
    lengths = [r.d for r in fit_list.select("d").distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS or max(lengths, default=0) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths, or of more than {MOST_DIMENSIONS} dimensions")
    fits: dict[int, Fit] = {}
    for r in sorted(total.collect(), key=lambda r: (r.d, r.i)):  # at most MOST_LENGTHS * MOST_DIMENSIONS rows
        fit = fits.setdefault(r.d, Fit(r.n, [], 0, []))
        fit.sums.append((int(r.high) << 32) + int(r.low))
        fit.reach = max(fit.reach, abs(fit.n * r.most - fit.sums[-1]), abs(fit.n * r.least - fit.sums[-1]))
    for fit in fits.values():
        fit.moduli = primes(2 * fit.n * fit.reach**2)
    return fits


def covariances(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """V of each length: modular products in the tasks, their sums by row of the matrix, and the remainder theorem there."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch, 0, 1):
                fit = fits[d]
                total = held.setdefault(d, np.zeros((len(fit.moduli), d, d), np.int64))
                for k, p in enumerate(fit.moduli):
                    z = ((x % p) * (fit.n % p) - np.array([s % p for s in fit.sums], np.int64)) % p
                    for at in range(0, len(z), ROWS):
                        block = z[at : at + ROWS].astype(float)
                        total[k] = (total[k] + (block.T @ block).astype(np.int64)) % p
        for d, total in held.items():
            rows = [total[:, i].astype("<i8").tobytes() for i in range(d)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array(rows, pa.binary())], names=["d", "i", "sums"])

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                residues = np.frombuffer(data, "<i8").reshape(-1, d)
                held[d, i] = residues if (d, i) not in held else held[d, i] + residues
        for (d, i), residues in held.items():
            fit = fits[d]
            exact = from_residues(residues, fit.moduli)
            row = [z / fit.n**3 for z in exact]  # integers of any size: rounded once
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([i]), pa.array([row], pa.list_(pa.float64()))], names=["d", "i", "row"])

    parts = fit_list.select("d", "x").mapInArrow(multiply, "d long, i long, sums binary")
    rows = parts.repartition("d", "i").mapInArrow(rebuild, "d long, i long, row array<double>").collect()  # d x d
    found = {d: np.zeros((d, d)) for d in fits}
    for r in rows:
        found[r.d][r.i] = r.row
    return found


def decompose(fit: Fit, v: np.ndarray, most: int) -> None:
    """The leading components of a covariance, by falling eigenvalue."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    kept = min(most, int((values > len(v) * np.finfo(float).eps * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    rows = vectors[:kept]
    largest = np.take_along_axis(rows, np.abs(rows).argmax(1)[:, None], 1) if kept else np.ones((0, 1))
    fit.components, fit.roots = rows * np.sign(largest), np.sqrt(values[:kept])
    fit.explained = values[:kept] / np.trace(v)


def identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """The largest absolute entry of the covariance of the whitened fit list, minus the identity, for each length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch, 0, 1):
                w = fits[d].whitened(fits[d].centred(x))
                held[d] = held.get(d, 0) + w.T @ w  # x is centred before it is projected
        for d, total in held.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["d", "i", "part"])

    sums = fit_list.select("d", "x").mapInArrow(run, "d long, i long, part double").groupBy("d", "i").agg(F.sum("part").alias("total"))
    found = dict.fromkeys(fits, 0.0)
    for r in sums.collect():  # components squared for each length
        k = len(fits[r.d].roots)
        found[r.d] = max(found[r.d], abs(r.total / fits[r.d].n - (r.i // k == r.i % k)))
    return found


def whiten(
    df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and leading component.

    deviation, the sum of squared z of a vector, is an exact decimal(38, 0).
    """
    small_batches(df.sparkSession)
    rows = integers(df, scale, shift, id_col, vector_col)
    fit_list = cut(rows.select("d", "x").distinct(), "fit")
    fits = sums(fit_list)
    for d, v in covariances(fit_list, fits).items():
        decompose(fits[d], v, components)
    errors = identity_errors(fit_list, fits)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch, 1, 2):
                fit = fits[d]
                k, z = len(fit.roots), fit.centred(x)
                if d * fit.reach**2 < SAFE:
                    deviation = pa.array((z * z).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in z], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(at)), k))
                columns = [
                    batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), fit.n)), deviation.take(each), pa.array(fit.whitened(z).ravel()),
                    pa.array(np.tile(fit.explained, len(at))), pa.array(np.full(len(each), errors[d])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
