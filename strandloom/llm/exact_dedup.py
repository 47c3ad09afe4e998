"""Exact duplicates by Patricia tries that own partitions of length and content hash.

The key of a text is its length, its content hash and then its bytes. Every task first inserts its own rows into
a trie, so that a group of copies leaves it as one row; the rows then go to the owner of their (length, hash),
sorted, and the owner inserts the whole byte strings into its trie. A terminal node keeps the identifier that
stays and the number of rows. Subtrees of different (length, hash) share nothing, so when a trie holds more bytes
than its budget, the subtrees that are complete are spilled: their terminals are written out and the nodes go.
The decision returns to the documents by an equi-join on the digest, whose large groups adaptive execution splits.

A null text counts as empty. Rows with an equal text form one group; rows that repeat an id as well all carry it,
and are kept or dropped together. Rows without an id are counted, and their id never stays unless all are without.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, small_batches

#: Bytes of text that a trie holds before its subtrees are spilled.
TRIE_BYTES = 32 << 20
HEAD = 16  # bytes of length and hash before the text


class Node:
    __slots__ = ("edge", "children", "keep", "count")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.keep, self.count = edge, None, None, 0


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals keep the best id and a count."""

    def __init__(self, best) -> None:
        self.best, self.root, self.bytes = best, Node(b""), 0
        self.root.children = {}

    def insert(self, key: bytes, keep: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = child = Node(key[at:])
                self.bytes += len(key) - at
            edge = child.edge
            if not key.startswith(edge, at):
                low, high = 0, min(len(edge), len(key) - at)
                while low < high:  # length of the common part
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if key.startswith(edge[:middle], at) else (low, middle - 1)
                upper = Node(edge[:low])
                child.edge = edge[low:]
                upper.children = {edge[low]: child}
                node.children[key[at]] = child = upper
            at += len(child.edge)
            node = child
        node.count += count
        if keep is not None:
            node.keep = keep if node.keep is None else self.best(node.keep, keep)

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            key = above + node.edge
            if node.count:
                yield key, node.keep, node.count
            stack.extend((child, key) for child in (node.children or {}).values())


def exact_duplicates(df: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; keep: "largest" or "smallest" id of a group stays."""
    best = {"largest": max, "smallest": min}[keep]
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    owned = rows.select(F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("hash"), "doc_id", F.col("text").cast("binary").alias("content"), F.lit(1).cast("long").alias("n"))
    kinds = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("content", pa.binary()), ("n", pa.int64())])

    def out(trie: PatriciaTrie) -> pa.RecordBatch:
        found = list(trie.terminals())
        sizes, hashes = ([int.from_bytes(k[i : i + 8], "big", signed=True) for k, _, _ in found] for i in (0, 8))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((sizes, hashes, [i for _, i, _ in found], [k[HEAD:] for k, _, _ in found], [n for _, _, n in found]), kinds.types, strict=True)], schema=kinds)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(best)
        for batch in batches:
            for size, h, doc_id, content, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(size.to_bytes(8, "big", signed=True) + h.to_bytes(8, "big", signed=True) + content, doc_id, n)
                if trie.bytes > trie_bytes:
                    yield out(trie)
                    trie = PatriciaTrie(best)
        yield out(trie)

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digested(trie: PatriciaTrie) -> pa.RecordBatch:
            found = list(trie.terminals())
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(memoryview(k)[HEAD:]).hexdigest() for k, _, _ in found], pa.string()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())], names=["text_sha256", "keep_id", "group_size"])

        trie, before = PatriciaTrie(best), b""
        for batch in batches:
            for size, h, doc_id, content, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = size.to_bytes(8, "big", signed=True) + h.to_bytes(8, "big", signed=True)
                if trie.bytes > trie_bytes and head != before:
                    yield digested(trie)
                    trie = PatriciaTrie(best)
                trie.insert(head + content, doc_id, n)
                before = head
        yield digested(trie)

    schema = "size long, hash long, doc_id long, content binary, n long"
    groups = owned.mapInArrow(local, schema).repartition("size", "hash").sortWithinPartitions("size", "hash").mapInArrow(own, "text_sha256 string, keep_id long, group_size long")
    digests = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return digests.join(groups.hint("merge"), "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
