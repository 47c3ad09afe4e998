"""Exact top-k inner products by best-first search over a forest of M-trees.

Inner products become distances: with M the largest norm, a vector x is seen as (x, sqrt(M^2 - |x|^2)) and a query
as (q, 0), so that d^2 = |q|^2 + M^2 - 2 q.x and the largest product is the nearest neighbour. Vectors are routed
to the nearest of a bounded number of pivots and dealt out over as many trees of a pivot as its rows need, so that a
tree has a bounded size at any input. Each tree is bulk-loaded into pages: an inner entry keeps a routing object,
the covering radius of its page and the distance to its parent; a leaf entry a vector and the distance to its
parent. A query descends the most promising page first; |d(q, parent) - d(entry, parent)| - radius bounds an entry
from stored distances alone and is tried before any distance is computed. A query first searches its home tree; the
k-th score found there lets it skip all trees of a pivot whose ball lies too far, and bounds the search in the
others. A task holds one tree and one block of queries. Scores are exact integers; bounds carry a slack against
rounding, so that nothing that ties is lost.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths are not compared. Rows that repeat an id, even with the same vector, are candidates and queries
one by one, each with its own ranks from 1, except that a query skips all rows with its own id. Equal scores are
ranked by id. Components must stay below 2**25 in size after scaling, else an error is raised. No vectors, no rows.
The driver holds one row for each vector length that occurs and one for each pivot.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import cut, discard, map_rows, small_batches

#: Rows of a tree, and queries that a task asks it, about; pivots, at most; rows that pivots are chosen from.
TREE_ROWS, BLOCK, PIVOTS, SAMPLE_ROWS = 4096, 2048, 1024, 2048
#: Entries of a page; rows of a batch of (query, tree) requests.
PAGE, REQUESTS = 64, 4096
#: Products up to this size are exact as doubles.
EXACT = 2.0**52
TREE = ["dim", "centre", "part"]
CELL = [*TREE, "block"]
PAGES = (
    "dim int, centre int, part int, page int, leaf boolean, refs array<long>, vectors binary, extra array<double>, "
    "radius array<double>, to_parent array<double>"
)


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, v (packed 64-bit integers), norm of the vectors that take part."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"vec_id": [], "dim": [], "v": [], "norm": []}
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if vec_id is None or vector is None or None in vector:
                continue
            x = np.floor(scale * np.array(vector, float))
            if not np.isfinite(x).all():
                continue
            if len(x) and np.abs(x).max() >= 1 << 25:
                raise ValueError(f"a component of vector {vec_id} is too large")
            x = x.astype(np.int64)
            for name, value in zip(out, (vec_id, len(x), x.tobytes(), int(x @ x)), strict=True):
                out[name].append(value)
        return out

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_rows(rows, kernel, "vec_id long, dim int, v binary, norm long")


def farthest_first(vectors: np.ndarray, extra: np.ndarray, count: int) -> list[int]:
    """Indices of up to count different pivots, each the farthest from those before."""
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < count:
        d = ((vectors - vectors[chosen[-1]]).astype(float) ** 2).sum(1) + (extra - extra[chosen[-1]]) ** 2
        far = np.minimum(far, d)
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return chosen


def distances(vectors: np.ndarray, extra: np.ndarray, v: np.ndarray, e: float) -> np.ndarray:
    return np.sqrt(((vectors - v).astype(float) ** 2).sum(1) + (extra - e) ** 2)


def build(ids: np.ndarray, vectors: np.ndarray, extra: np.ndarray) -> list[tuple]:
    """Pages (page, leaf, refs, vectors, extra, radius, to_parent) of a bulk-loaded tree; page 0 is the root."""
    pages: list[tuple] = []

    def load(rows: np.ndarray, parent: int | None) -> int:
        page = len(pages)
        pages.append(())
        heads, members = rows, None
        if len(rows) > PAGE:
            pivots = rows[farthest_first(vectors[rows], extra[rows], min(PAGE, -(-len(rows) // PAGE)))]
            if len(pivots) > 1:
                to = np.stack([distances(vectors[rows], extra[rows], vectors[p], extra[p]) for p in pivots])
                members = [rows[to.argmin(0) == i] for i in range(len(pivots))]
            if members is None or max(map(len, members)) == len(rows):  # equal vectors: any split does
                members = np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))
                pivots = [m[0] for m in members]
            heads = np.array(pivots)
        radius, refs = [0.0] * len(heads), ids[heads].tolist()
        if members is not None:
            refs = [load(m, h) for m, h in zip(members, heads, strict=True)]
            spans = (distances(vectors[m], extra[m], vectors[h], extra[h]) for m, h in zip(members, heads, strict=True))
            radius = [float(span.max()) for span in spans]
        if parent is None:
            to_parent = [0.0] * len(heads)
        else:
            to_parent = distances(vectors[heads], extra[heads], vectors[parent], extra[parent]).tolist()
        pages[page] = (page, members is None, refs, vectors[heads].tobytes(), extra[heads].tolist(), radius, to_parent)
        return page

    load(np.arange(len(ids)), None)
    return pages


class Tree:
    """Pages of one tree, read for searching by queries that a block holds."""

    def __init__(self, pages: pd.DataFrame, dim: int, most: float):
        self.pages, self.most, self.seen = {}, most, 0
        for row in pages.itertuples():
            refs = np.array(row.refs, np.int64)
            vectors = np.frombuffer(row.vectors, np.int64).reshape(len(refs), dim)
            own = (refs, vectors, vectors.astype(float), np.array(row.radius, float), np.array(row.to_parent, float))
            self.pages[row.page] = (row.leaf, *own)

    def search(self, own: int, q: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of the tree but the query's own, without what cannot reach the bound."""
        norm = float(q @ q)
        base = norm + self.most  # d^2 = base - 2 score
        slack = 1e-6 * math.sqrt(base) + 1e-6
        whole = math.sqrt(norm * self.most) >= EXACT  # else products of doubles are exact
        q = q if whole else q.astype(float)
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id), the worst first
        queue: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
        least = -math.inf if bound is None else bound
        far = math.inf if bound is None else math.sqrt(max(0.0, base - 2 * bound)) + slack
        while queue:
            nearest, page, to_q = heapq.heappop(queue)
            if nearest > far:
                break
            self.seen += 1
            leaf, refs, integers, doubles, radius, to_parent = self.pages[page]
            vectors = integers if whole else doubles
            if to_q is not None:
                at = np.flatnonzero(np.abs(to_q - to_parent) - radius <= far)
                if len(at) < len(refs):
                    refs, vectors, radius = refs[at], vectors[at], radius[at]
            scores = vectors @ q
            if not leaf:
                d = np.sqrt(np.maximum(0.0, base - 2.0 * scores))
                near = np.maximum(0.0, d - radius)
                for i in np.flatnonzero(near <= far).tolist():
                    heapq.heappush(queue, (float(near[i]), int(refs[i]), float(d[i])))
                continue
            for i in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[i]), -int(refs[i]))
                if -entry[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
                far = math.sqrt(max(0.0, base - 2 * least)) + slack
        return [(score, -vec_id) for score, vec_id in best]


@dataclass(frozen=True)
class Routing:
    """Of one vector length: M^2, and of each pivot its vector, last coordinate, radius of what it holds and trees."""

    most: float
    centres: np.ndarray
    extras: np.ndarray
    radii: np.ndarray
    parts: np.ndarray


def index(vectors: DataFrame, tree_rows: int = TREE_ROWS) -> tuple[DataFrame, DataFrame, dict[int, Routing]]:
    """Pages of the forest, the vectors (row, vec_id, dim, v, norm) with their trees, and the routing of each length."""
    totals = vectors.groupBy("dim").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect()
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).collect()
    pivots = {}
    for total in totals:
        own = [np.frombuffer(row.v, np.int64) for row in sample if row.dim == total.dim]
        own = np.array(own, np.int64).reshape(len(own), total.dim) if own else np.zeros((1, total.dim), np.int64)
        extra = np.sqrt(np.maximum(0.0, total.most - (own * own).sum(1).astype(float)))
        chosen = farthest_first(own, extra, min(PIVOTS, -(-total.n // (2 * tree_rows))))
        pivots[total.dim] = (float(total.most), own[chosen], extra[chosen])

    def kernel(batch: pa.RecordBatch) -> dict:
        near, far = [], []
        for dim, v, norm in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            most, centres, extras = pivots[dim]
            d = distances(centres, extras, np.frombuffer(v, np.int64), math.sqrt(max(0.0, most - norm)))
            near.append(int(d.argmin()))
            far.append(float(d.min()))
        names = ("row", "vec_id", "dim", "v", "norm")
        return dict(zip(names, batch.columns, strict=True)) | {"centre": near, "far": far}

    schema = "row long, vec_id long, dim int, v binary, norm long, centre int, far double"
    routed = cut(map_rows(vectors.select("row", "vec_id", "dim", "v", "norm"), kernel, schema), "routed")
    routing = {}
    for dim, (most, centres, extras) in pivots.items():
        routing[dim] = Routing(most, centres, extras, np.zeros(len(centres)), np.zeros(len(centres), np.int64))
    held = routed.groupBy("dim", "centre").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    for row in held.collect():  # a row for each pivot
        routing[row.dim].radii[row.centre], routing[row.dim].parts[row.centre] = row.far, -(-row.n // tree_rows)
    parts = F.create_map(*(F.lit(x) for dim, r in routing.items() for c, n in enumerate(r.parts.tolist()) if n for x in (f"{dim}:{c}", n)))
    place = F.pmod(F.xxhash64("row"), parts[F.concat_ws(":", "dim", "centre")] if routing else F.lit(1))
    routed = routed.withColumn("part", place.cast("int"))

    def load(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = [int(pdf[name].iloc[0]) for name in TREE]
        v = np.array([np.frombuffer(x, np.int64) for x in pdf.v], np.int64).reshape(len(pdf), tree[0])
        pages = build(pdf.vec_id.to_numpy(np.int64), v, np.sqrt(np.maximum(0.0, routing[tree[0]].most - pdf.norm.to_numpy(float))))
        names = [*TREE, "page", "leaf", "refs", "vectors", "extra", "radius", "to_parent"]
        return pd.DataFrame([(*tree, *p) for p in pages], columns=names)

    return cut(routed.groupBy(*TREE).applyInPandas(load, PAGES), "mtree"), routed, routing


def top_k(
    df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    tree_rows: int = TREE_ROWS, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k largest products with the others."""
    small_batches(df.sparkSession)
    vectors = cut(quantised(df, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    pages, routed, routing = index(vectors, tree_rows)
    asking = routed.where(F.col("vec_id") % every == 0)
    blocks = -(-asking.count() // block) or 1
    # Each query has the number of its row, so that queries with the same id and vector stay apart.
    block_of = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    queries = asking.select(*TREE, block_of, F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    home = cut(search(pages, cut(queries.withColumn("bound", F.lit(None).cast("long")), "asked"), routing, k), "home")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            found = pa.RecordBatch.from_arrays(arrays, names=[*CELL, "query", "query_id", "q", "bound"])
            held.clear()
            return found

        for batch in batches:
            for dim, centre, part, *same, q, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = routing[dim]
                x = np.frombuffer(q, np.int64)
                base = float(x @ x) + of.most
                d = np.sqrt(np.maximum(0.0, base - 2.0 * (of.centres @ x)))
                far = math.inf if bound is None else math.sqrt(max(0.0, base - 2 * bound)) * (1 + 1e-6) + 1e-3
                for c in np.flatnonzero(d - of.radii <= far).tolist():
                    for p in range(int(of.parts[c])):
                        if (c, p) != (centre, part):
                            held.append((dim, c, p, *same, q, bound))
                            if len(held) == REQUESTS:
                                yield out()
        if held:
            yield out()

    kth = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select("query", F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    asked = queries.join(kth, "query", "left").select(*CELL, "query", "query_id", "q", "bound")
    asked = asked.mapInArrow(others, "dim int, centre int, part int, block int, query long, query_id long, q binary, bound long")
    found = cut(home.unionByName(search(pages, cut(asked, "asked"), routing, k)), "found")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    discard(vectors, pages, home)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(pages: DataFrame, asked: DataFrame, routing: dict[int, Routing], k: int) -> DataFrame:
    """query, query_id, vec_id, score: the best k of every asked tree; asked is a table with CELL, query, query_id, q, bound."""

    def run(tree_pages: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree_pages) and len(wanted):
            dim = int(wanted.dim.iloc[0])
            tree = Tree(tree_pages, dim, routing[dim].most)
            for row in wanted.itertuples():
                bound = None if pd.isna(row.bound) else int(row.bound)
                found = tree.search(int(row.query_id), np.frombuffer(row.q, np.int64), k, bound)
                out += [(row.query, row.query_id, vec_id, score) for score, vec_id in found]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"]).astype("int64")

    # A tree goes to the blocks of queries that ask it, and to no other.
    wanted = pages.join(asked.select(*TREE, F.col("block").alias("asks")).distinct(), TREE)
    return wanted.groupBy(*TREE, "asks").cogroup(asked.groupBy(*CELL)).applyInPandas(run, "query long, query_id long, vec_id long, score long")
