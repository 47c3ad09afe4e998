"""Alignment of two tokenizers over the bytes of each text, by elementary intervals.

A is a byte-level BPE vocabulary and encodes a space and the text; B is a sentencepiece model and encodes the text,
before which it puts a space itself. Both sequences of tokens then cover the same bytes. The ends of both are united
(``union1d``) into elementary intervals, each of which has one owner in A and one in B (``searchsorted``): it is one
overlap of two tokens. Where both owners end with their interval, a group closes: the tokens since the last such end.

Links of a text are pairs of token occurrences: ``ends`` are those whose byte ranges end together, ``overlaps`` those
that share a byte, ``groups`` all of a group, as the product of its tokens. Pairs of ids are counted over the corpus,
and each text gets how its links stand in these counts.

How it runs: texts are encoded and aligned once, in blocks of a bounded size, and written as one row a text that
holds its distinct pairs with their numbers. Pairs are summed before the shuffle. The counts of the most frequent
pairs (``FREQUENT``, 17 bytes each) are broadcast and looked up where the rows are; the rest, which no text has
often, is joined by pair. So no hot pair crosses the network, and nothing depends on where the line is drawn.

Nulls and empty texts have no tokens, as have texts whose bytes differ from what either tokenizer covers (a text with
the space mark of B): their numbers are 0 and groups_sha256 is empty. Special strings in a text are plain text. Ids may
be null or repeat: every row is counted and answered by itself. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bpe_automaton import CACHE_CHARS, CACHE_ENTRIES, automaton
from strandloom.llm.common import cut, discard, id_and_text, small_batches
from strandloom.llm.token_counts import MARK, PRE_TOKEN, PieceCounter

#: Pairs whose counts are broadcast, at most (17 bytes each).
FREQUENT = 1 << 18
#: Bytes of text that are aligned at once, about; a longer text is one block of its own.
BLOCK_BYTES = 1 << 20
LINKS = ("ends", "overlaps", "groups")


class PieceEncoder(PieceCounter):
    """Ids and bytes of the tokens of one sentencepiece model."""

    def __init__(self, path: str):
        super().__init__(path)
        model: sentencepiece.SentencePieceProcessor = self.model
        self.labels = [self._label(i) for i in range(model.get_piece_size())]
        self.lone_mark = array("I", [model.piece_to_id(MARK)]).tobytes()
        self.before = len(model.encode("\n"))
        self.ids: dict[str, bytes] = {}

    def _label(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode()

    def _learn(self, words: set[str]) -> None:
        """Keep the ids of pre-tokens, which the library encodes all at once."""
        spaced = [w for w in words if w[0] in (" ", MARK)]  # the library puts one space mark before every text
        for word, ids in zip(spaced, self.model.encode([w[1:] for w in spaced], num_threads=1), strict=True):
            self.ids[word] = array("I", ids).tobytes() if len(word) > 1 else self.lone_mark
        inner = [w for w in words if w[0] not in (" ", MARK)]
        for word, ids in zip(inner, self.model.encode(["\n" + w for w in inner], num_threads=1), strict=True):
            self.ids[word] = array("I", ids[self.before :] if word != "\n" else ids[1 : self.before]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pre-tokens are kept in a cache of bounded size."""
        words = [PRE_TOKEN(" " + t) if t else [] for t in texts]
        if len(self.ids) > CACHE_ENTRIES:
            self.ids.clear()
        new = set().union(*words).difference(self.ids)
        self._learn(new)
        out = [b"".join(map(self.ids.__getitem__, w)) for w in words]
        for word in new:
            if len(word) > CACHE_CHARS:
                del self.ids[word]
        return out


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What union1d gives for two ascending arrays; a stable sort merges them in linear time."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return both[new]


def joined_labels(ids: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of tokens, one after the other."""
    n = sizes[ids]
    ends = np.cumsum(n)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - ends + n, n)].tobytes()


class Aligner:
    """Both tokenizers of a worker, with tables of what their tokens cover and how ids are written."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = automaton(path_a), PieceEncoder(path_b)
        self.labels_a, self.labels_b = map(self._table, (self.a.labels, self.b.labels))
        self.sizes_a, self.sizes_b = self.labels_a[2], self.labels_b[2]
        self.n_b = len(self.b.labels)
        self.digits_a, self.digits_b = (np.array([len(str(i)) + 1 for i in range(len(x))]) for x in (self.sizes_a, self.sizes_b))  # with a mark
        self.written = {(side, mark): np.array([f"{i}{mark}" for i in range(n)], "S") for side, n, mark in
                        (("a", len(self.sizes_a), ","), ("a", len(self.sizes_a), "|"), ("b", self.n_b, ","), ("b", self.n_b, ";"))}

    @staticmethod
    def _table(labels: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all labels, where each begins and how long it is."""
        sizes = np.array([len(x) for x in labels], np.int64)
        return np.frombuffer(b"".join(labels), np.uint8), np.cumsum(sizes) - sizes, sizes

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each text, both empty where they do not cover the same bytes."""
        whole = [" " + t if t else "" for t in texts]
        data = [t.encode() for t in whole]
        ids_a = [np.frombuffer(self.a.encode_plain(t), "<u4").astype(np.int64) for t in whole]
        ids_b = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.b.encode(texts)]
        wrong: set[int] = set()
        for ids, labels in ((ids_a, self.labels_a), (ids_b, self.labels_b)):
            if joined_labels(np.concatenate(ids), *labels) != b"".join(data):
                wrong |= {i for i, (x, d) in enumerate(zip(ids, data, strict=True)) if joined_labels(x, *labels) != d}
        nothing = np.empty(0, np.int64)
        return [(nothing, nothing) if i in wrong else pair for i, pair in enumerate(zip(ids_a, ids_b, strict=True))]

    def align(self, texts: list[str], links: str) -> dict:
        """Columns of the texts of one block, which are aligned as if they were one."""
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(t[i]) for t in tokens], np.int64) for i in (0, 1))
        a, b = (np.concatenate([t[i] for t in tokens]) for i in (0, 1))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        # Elementary intervals, told by their ends; every text ends both, so none crosses from one text to the next.
        ends = united(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
        last_a, last_b = owner_a[shared], owner_b[shared]
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        if links == "ends":
            link_a, link_b = last_a, last_b
        elif links == "overlaps":
            link_a, link_b = owner_a, owner_b
        else:
            link_a, link_b = products(group_a, group_b, len(last_a))
        text_a, text_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        link_text = text_a[link_a]
        n_groups = np.bincount(text_a[last_a], minlength=len(texts)).astype(np.int64)
        n_links = np.bincount(link_text, minlength=len(texts)).astype(np.int64)
        written = self._written(a, b, group_a, group_b, last_a, last_b)
        per_a, per_b = (np.concatenate(([0], np.cumsum(size[ids])))[np.concatenate(([0], np.cumsum(n)))] for size, ids, n in ((self.digits_a, a, n_a), (self.digits_b, b, n_b)))
        data, cuts = written.tobytes().replace(b"\0", b""), per_a + per_b
        digests = [hashlib.sha256(data[f : t - 1]).hexdigest() if t > f else "" for f, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        pairs, starts, times = distinct_pairs(link_text, a[link_a] * self.n_b + b[link_b], len(texts))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests,
            "pairs": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pairs, pa.int64())),
            "times": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(times, pa.int64())),
        }

    def _written(self, a, b, group_a, group_b, last_a, last_b) -> np.ndarray:
        """All tokens as their decimal ids, each with the mark that follows it: a group's tokens of A, then those of B."""
        place_a = np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]  # after B's tokens of earlier groups
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]  # after A's tokens up to this group
        of_a, of_b = self.written["a", ","][a], self.written["b", ","][b]
        of_a[last_a], of_b[last_b] = self.written["a", "|"][a[last_a]], self.written["b", ";"][b[last_b]]
        out = np.empty(len(a) + len(b), max(of_a.dtype, of_b.dtype, key=lambda t: t.itemsize))
        out[place_a], out[place_b] = of_a, of_b
        return out


def products(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one token of A and one of B in the same group."""
    of_b = np.bincount(group_b, minlength=groups)
    starts = np.cumsum(of_b) - of_b
    many = of_b[group_a]  # partners of each token of A
    link_a = np.repeat(np.arange(len(group_a)), many)
    nth = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many)
    return link_a, starts[group_a[link_a]] + nth


def distinct_pairs(text: np.ndarray, pair: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each text in order, where each text's begin, and how often each occurs there."""
    order = np.lexsort((pair, text))
    text, pair = text[order], pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(pair)))
    return pair[first], np.searchsorted(text[first], np.arange(texts + 1)), times


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def blocks(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of about most bytes."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(text) + 1
    if held:
        yield slice(start, len(texts))


def aligned(df: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row.

    A pair is the id of A times the size of B's vocabulary plus the id of B; times is how many links of the text it has.
    """
    if links not in LINKS:
        raise ValueError(f"links {links}: one of {', '.join(LINKS)}")
    small_batches(df.sparkSession)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in blocks(texts, BLOCK_BYTES):
                columns = aligner(path_a, path_b).align(texts[part], links)
                own = batch.slice(part.start, part.stop - part.start)
                out = [c if isinstance(c, pa.Array) else pa.array(c) for c in map(columns.__getitem__, names)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *out], names=["row", "doc_id", *names])

    rows = id_and_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return rows.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each pair, and whether no pair of its B id has more.

    The highest counts have a row for each id of B, so they are broadcast.
    """
    counts = cut(rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")), "pairs")
    of_b = F.pmod("pair", F.lit(n_b))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))
    out = counts.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    out.cut_path = counts.cut_path
    return out


def alignment(
    df: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_best: links whose pair no other of the same B id exceeds in the corpus; count_sum: the sum of the links' counts.
    """
    spark = df.sparkSession
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = cut(aligned(df, path_a, path_b, links, id_col, text_col), "aligned")
    counts = pair_counts(rows, n_b)
    top = counts.orderBy(F.desc("n")).limit(frequent).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    fixed = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            held = batch.column(7)
            values, times = held.flatten().to_numpy(), batch.column(8).flatten().to_numpy()
            cuts = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
            at = np.minimum(np.searchsorted(pair, values), max(len(pair) - 1, 0))
            hit = pair[at] == values if len(pair) else np.zeros(len(values), bool)
            at = at[hit]
            sums = []
            for each in (best[at] * times[hit], n[at] * times[hit]):
                full = np.zeros(len(values) + 1, np.int64)
                full[1:][hit] = each
                full = np.cumsum(full)
                sums.append(pa.array(full[cuts[1:]] - full[cuts[:-1]]))
            starts = np.concatenate(([0], np.cumsum(~hit)))[cuts]
            rest = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v[~hit], pa.int64())) for v in (values, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *sums, *rest], names=[*fixed, "n_best", "count_sum", "pairs", "times"])

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in fixed)
    found = rows.mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<long>, times array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if len(order) < frequent:  # every pair is known
        discard(counts)
        return found.select(*out)
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    late = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("late_best"), F.sum(F.col("n") * F.col("times")).alias("late_sum"))
    whole = found.drop("pairs", "times").join(late, "row", "left")
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return whole.withColumns({"n_best": add("n_best", "late_best"), "count_sum": add("count_sum", "late_sum")}).select(*out)
