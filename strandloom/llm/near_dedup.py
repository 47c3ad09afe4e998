"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. A text becomes its set of distinct word shingles (64-bit hashes). Rounds of hashing throw every shingle into
   one of the bins of a sketch: a bin keeps the smallest (round, value) that it got, rounds go on until no bin is
   empty, and from round ``bins`` on, round ``bins + i`` aims at bin i alone, which guarantees the filling.
2. Documents with the same set are one class, represented by its smallest id; only classes go on.
3. The sketch is cut into bands. In every bucket of a band the classes are compared with the bucket's smallest
   one, on full sets, and what is linked is joined to components. A bucket costs one pair for each member.
4. Buckets that still hold more than one component are not given up: all their members are joined exactly by
   prefix filtering. Shingles are ordered from rare to frequent among these members; two sets that reach the
   threshold share one of their rarest ``n - ceil(threshold * n) + 1`` shingles. Shingles that one member alone
   has need no partner. The members of a list of such a shingle are compared inside tasks, by products of small
   incidence matrices. What comes out is a spanning forest: a link that joins two components that were apart, so a
   cell of m components gives m - 1 rows at most. Lists that hang together are compared as one group; a group
   above ``BLOCK`` members is dealt out in blocks, and two blocks that hold one and the same component never meet.
5. Components of all confirmed links go back to the documents.

Every link that shares a band is found or bridged by a path of confirmed links. A pair at the threshold of 0.8
shares none of the 30 bands of 4 with probability 1.4e-7, and less above it.

A null or wordless text has an empty set and links with nothing. Rows that repeat an id are one document; if their
texts differ, it links by any of the sets that are its own, but the full set by which a class it represents is compared
is that of one of them, and which one depends on partitioning: such rows should get ids of their own. Rows without an
id never represent a class. Ties go to the smallest id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.bpe_automaton import Cache
from strandloom.llm.common import cut, discard, id_and_text, map_rows, small_batches
from strandloom.llm.components import connected_components

BANDS, BAND_ROWS = 30, 4
#: Members of a list that is compared alone, and of a group or a block that one task compares; shingles of a block.
LIST, BLOCK, BLOCK_ITEMS = 256, 2048, 2_000_000
#: Members that meet in one matrix product, and columns of the matrices.
PART, COLUMNS = 256, 4096
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # fixed values: mixing multipliers

_WORDS = Cache(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Distinct shingles, sorted: ASCII letters lowered, words cut at ASCII white space, fewer words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            x = mix(x * ODD[2] + h[i : len(h) - width + 1 + i])
    return np.unique(x)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    at, missing = 0, bins
    with np.errstate(over="ignore"):
        while missing and at < bins:
            rounds = np.arange(at, min(bins, at + max(1, -(-4 * bins // len(items)))), dtype=np.uint64)
            h = mix(items[None, :] ^ mix(rounds * ODD[2] + ODD[1])[:, None])
            where = (h % np.uint64(bins)).ravel()
            key = (mix(h) >> np.uint64(12) | rounds[:, None] << np.uint64(52)).ravel()  # the round counts first
            order = np.argsort(key)[::-1]
            fresh = out.copy()
            fresh[where[order]] = key[order]  # the smallest key of a bin is written last
            out = np.minimum(out, fresh)
            at, missing = at + len(rounds), int((out == np.iinfo(np.uint64).max).sum())
        for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
            out[i] = np.uint64(bins + i) << np.uint64(48) ^ mix(items ^ mix(np.uint64([bins + i]) * ODD[2] + ODD[1])).min() >> np.uint64(16)
    return out


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the sketch."""
    grid = sketch(items, bands * rows).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix(key * ODD[2] + grid[:, i])
    return key.view(np.int64)


def sketched(rows: DataFrame, width: int, bands: int, band_rows: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits, null if empty), bands of every row."""

    def kernel(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "bands": [band_keys(s, bands, band_rows) if len(s) else None for s in sets],
        }

    return map_rows(rows, kernel, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def full_sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, leads and the packed shingles of the documents in ids (doc_id, leads), once each."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "leads": batch.column(1), "items": [shingles(t, width).tobytes() for t in batch.column(2).to_pylist()]}

    once = rows.join(ids.hint("merge"), "doc_id").dropDuplicates(["doc_id"])  # the join has brought equal ids together
    return map_rows(once.select("doc_id", "leads", "text"), kernel, "doc_id long, leads boolean, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; b leads a bucket."""

    def kernel(batch: pa.RecordBatch) -> dict:
        a, b, kept = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                kept.append(i)
        return {"a": [a[i] for i in kept], "b": [b[i] for i in kept]}

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), sets.where("leads").select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    return map_rows(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "items_a", "items_b"), kernel, "a long, b long")


def similar_sizes(percent: int) -> Callable[[str, str], Column]:
    return lambda m, n: F.lit(100) * F.least(m, n) >= F.lit(percent) * F.greatest(m, n)


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the smallest id of a component) of every row; linked at percent / 100."""
    small_batches(df.sparkSession)
    fits = similar_sizes(percent)
    rows = id_and_text(df, id_col, text_col)
    docs = cut(sketched(rows, width, bands, band_rows), "sketches")
    classes = docs.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"))
    classes = cut(classes.where("doc_id IS NOT NULL"), "classes")
    chosen = docs.join(classes.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    chosen = cut(chosen.select("doc_id", F.col("n_shingles").alias("n"), "bands"), "chosen")
    banded = chosen.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("leader"), F.count("*").alias("size"))
    buckets = buckets.where("size > 1").select("key", F.col("leader.doc_id").alias("b"), F.col("leader.n").alias("n_b"))
    buckets = cut(buckets, "buckets")  # as a table, so that the join below can split a hot bucket
    members = cut(banded.join(buckets.hint("merge"), "key"), "members")
    discard(chosen, buckets)

    own = F.max(F.col("doc_id") == F.col("b"))
    sets = cut(full_sets(rows, members.groupBy("doc_id").agg(own.alias("leads")), width), "sets")
    star = members.where((F.col("doc_id") != F.col("b")) & fits("n", "n_b")).select(F.col("doc_id").alias("a"), "b")
    links = cut(confirmed(star.distinct(), sets, percent), "links")
    labels = connected_components(links)

    named = labels.select(F.col("id").alias("doc_id"), "component")
    labelled = members.select("key", "doc_id", "n").join(named, "doc_id", "left")
    labelled = cut(labelled.withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = cut(mixed.where("low < high").select("key"), "mixed")
    rest = cut(labelled.join(mixed.hint("merge"), "key").select("doc_id", "n", "component").distinct(), "rest")
    discard(members, labelled, mixed)
    # Every component of the first links hangs together by a row for each member; the rest adds a forest over them.
    joined = named.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    components = connected_components(joined.unionByName(links_of_rest(rest, sets, percent)))
    discard(labels, links, rest, sets)

    found = classes.join(components.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    found = found.select("set_hash", F.coalesce("component", "doc_id").alias("component_id"))
    out = docs.select("doc_id", "n_shingles", "set_hash").join(found.hint("merge"), "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of left reach the threshold with which of right, as a matrix; right may be left itself."""
    counted = [np.array([len(x) for x in side]) for side in (left, right)]
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sides = np.split(column, [int(counted[0].sum())])
    seen = [np.bincount(side, minlength=int(column.max()) + 1) for side in sides]
    shared = seen[0] > 1 if left is right else (seen[0] > 0) & (seen[1] > 0)
    number, common = np.cumsum(shared) - 1, np.zeros((len(left), len(right)), np.float32)
    sparse = []
    for side, sizes in zip(sides, counted, strict=True):
        keep = shared[side]
        owner, at = np.repeat(np.arange(len(sizes)), sizes)[keep], number[side[keep]]
        order = np.argsort(at, kind="stable")
        sparse.append((owner[order], at[order], len(sizes)))
    for first in range(0, int(shared.sum()), COLUMNS):
        dense = []
        for owner, at, n in sparse:
            low, high = np.searchsorted(at, (first, first + COLUMNS))
            has = np.zeros((n, COLUMNS), np.float32)
            has[owner[low:high], at[low:high] - first] = 1
            dense.append(has)
        common += dense[0] @ dense[1].T
    both = counted[0][:, None] + counted[1][None, :]
    return 100 * common.astype(np.int64) >= percent * (both - common.astype(np.int64))


def spanning_links(sets: list[np.ndarray], components: list[int], blocks: list[str], percent: int) -> list[tuple[int, int]]:
    """Index pairs of linked sets that join the given components: a spanning forest, no pair within what hangs together.

    If there are two blocks, only links across them are looked for. Rows are fewer than the components.
    """
    label = np.unique(np.array(components), return_inverse=True)[1]
    block = np.unique(np.array(blocks), return_inverse=True)[1]
    order = np.lexsort((label, block))
    parts = [
        own[at : at + PART] for b in range(int(block.max()) + 1) for own in [order[block[order] == b]] for at in range(0, len(own), PART)
    ]
    found = []
    for i, p in enumerate(parts):
        for q in parts[i:]:
            both = np.concatenate([p, q])
            if block.max() and block[p[0]] == block[q[0]] or (label[both] == label[both[0]]).all():
                continue
            left = [sets[k] for k in p]
            near = linked(left, left if q is p else [sets[k] for k in q], percent)
            while (apart := near & (label[p][:, None] != label[q][None, :])).any():
                x, y = np.unravel_index(apart.argmax(), apart.shape)
                found.append((int(p[x]), int(q[y])))
                label[label == label[q[y]]] = label[p[x]]
    return found


def united(listed: DataFrame, rest: DataFrame) -> DataFrame:
    """grp, doc_id, component, n, size, items: the members of lists (doc_id, b) that are joined by shared members."""
    found = connected_components(listed.select(F.col("doc_id").alias("a"), "b").distinct())
    found = cut(found.select(F.col("component").alias("grp"), F.col("id").alias("doc_id")).join(rest, "doc_id"), "groups")
    sizes = cut(found.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("items")), "sizes")
    return found.join(sizes.hint("merge"), "grp")  # two tables, so that a hot group can be split


def in_blocks(members: DataFrame) -> DataFrame:
    """grp, i, j, block, doc_id: every cell of two blocks of a group (grp, doc_id, component, n) that can hold a link.

    A component above a block's size has blocks of its own, which meet all blocks but those of the same component;
    the other members of a group are dealt out by a hash.
    """
    own = members.groupBy("grp", "component").agg(F.count("*").alias("size"), F.sum("n").alias("items"))
    full = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("items") / F.lit(BLOCK_ITEMS))).alias("blocks")
    own = cut(own.withColumn("pure", F.when(F.col("size") > BLOCK, F.col("component"))), "sizes")
    blocks = own.groupBy("grp", "pure").agg(F.sum("size").alias("size"), F.sum("items").alias("items")).select("grp", "pure", full)
    blocks = cut(blocks, "blocks")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("number")
    name = F.concat_ws(":", F.coalesce(F.col("pure").cast("string"), F.lit("mixed")), "number")
    every = blocks.select("grp", "pure", number).select("grp", F.struct(F.col("pure"), name.alias("name")).alias("other"))
    every = cut(every.groupBy("grp").agg(F.collect_list("other").alias("others")), "others")  # a few entries for each BLOCK members
    placed = members.join(own.select("grp", "component", "pure").hint("merge"), ["grp", "component"])
    count = blocks.select("grp", F.col("pure").alias("pure_of"), "blocks")
    placed = placed.join(count.hint("merge"), ["grp"]).where(F.col("pure").eqNullSafe(F.col("pure_of")))
    placed = placed.withColumn("number", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).select("grp", "doc_id", "pure", name.alias("block"))
    meets = placed.join(every.hint("merge"), "grp").select("grp", "doc_id", "block", "pure", F.explode("others").alias("other"))
    meets = meets.where(F.col("pure").isNull() | ~F.col("pure").eqNullSafe(F.col("other.pure")))
    return meets.select("grp", F.least("block", "other.name").alias("i"), F.greatest("block", "other.name").alias("j"), "block", "doc_id")


def links_of_rest(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all linked components of rest, by prefix filtering over its full sets."""
    own = sets.select("doc_id", "items").join(rest.select("doc_id", "component"), "doc_id")

    def spread(batch: pa.RecordBatch) -> dict:
        ids, items = batch.column(0).to_pylist(), [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        sizes = [len(x) for x in items]
        return {
            "doc_id": pa.array(np.repeat(np.array(ids, np.int64), sizes)),
            "item": pa.array(np.concatenate(items) if items else np.empty(0, np.int64)),
            "n": pa.array(np.repeat(np.array(sizes, np.int32), sizes)),
        }

    every = map_rows(own.select("doc_id", "items"), spread, "doc_id long, item long, n int")
    frequency = cut(every.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    shared = every.join(frequency.hint("merge"), "item")
    # The shingles that no other member has come first in a prefix and fill part of it.
    of_doc = Window.partitionBy("doc_id")
    place = F.row_number().over(of_doc.orderBy("df", "item")) + F.col("n") - F.count("*").over(of_doc)
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1
    posted = shared.withColumn("place", place).where(F.col("place") <= prefix).select("item", "doc_id")
    posted = cut(posted.join(rest.select("doc_id", "component"), "doc_id"), "postings")
    # Lists with the same members are one list: compared by size, smallest member and two 64-bit hashes of them all.
    members = [
        F.count("*").alias("size"), F.min("doc_id").alias("b"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    ]
    lists = posted.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high"), *members)
    lists = lists.where("low < high").groupBy("size", "b", "x", "y").agg(F.min("item").alias("item")).select("item", "size", "b")
    listed = cut(posted.join(lists.hint("merge"), "item").select("item", "doc_id", "size", "b"), "lists")
    discard(frequency, posted)
    # Lists that hang together are one group as long as a task can compare that: a member then travels once.
    groups, fits = united(listed, rest), (F.col("size") <= BLOCK) & (F.col("items") <= 2 * BLOCK_ITEMS)
    alone = [F.lit("").alias("i"), F.lit("").alias("j"), F.lit("").alias("block"), "doc_id"]
    modest = groups.where(fits).select(F.lit("group").alias("kind"), "grp", *alone)
    large = listed.join(groups.where(~fits).select("doc_id"), "doc_id", "left_semi")
    short = large.where(F.col("size") <= LIST).select(F.lit("list").alias("kind"), F.col("item").alias("grp"), *alone)
    long = united(large.where(F.col("size") > LIST), rest).drop("size", "items")
    long = in_blocks(long).select(F.lit("blocks").alias("kind"), "grp", "i", "j", "block", "doc_id")
    dealt = modest.unionByName(short).unionByName(long)
    key = ["kind", "grp", "i", "j"]
    cells = dealt.join(own.hint("merge"), "doc_id").select(*key, "block", "doc_id", "component", "items")
    # By id too: which forest is found depends on the order, and a task that runs again must find the same one.
    cells = cells.repartition(*key).sortWithinPartitions(*key, "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            blocks, ids, components, items = zip(*held, strict=True)
            found = spanning_links([np.frombuffer(x, np.uint64) for x in items], components, blocks, percent)
            pairs = [sorted((ids[i], ids[j])) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            for *cell, block, doc_id, component, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    if held:
                        yield out(held)
                    now, held = cell, []
                held.append((block, doc_id, component, items))
        if held:
            yield out(held)

    return cells.mapInArrow(compare, "a long, b long")
