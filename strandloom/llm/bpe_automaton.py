"""Byte-level BPE as a deterministic automaton.

**Gadgets.** The merges are compiled one after the other into an automaton over tokens. It starts with one state for
each byte, and arcs from every state to every byte. The gadget of a merge (a, b) -> c adds a state c that is a copy
of the state behind b, takes the arc b away from the state behind a, and adds an arc c to every state that still has
an arc a. The integer tables hold each gadget's change once: the arc it took, the state it copied, the arc whose
holders got the new one, and when. The full table of arcs would be the square of the vocabulary, so an arc is read
through these changes when it is first needed (``MergeGadgets.arc``) and kept.

**Bytes.** A byte string has exactly one path through that automaton: its BPE encoding. Subset construction makes it
deterministic over bytes: a state is the set of live paths, each being the token state where it stands and the node
of the byte trie that it has reached on its next arc. Deep in the trie a path is told by the arcs that are still open
to it, so that paths with one future are one and those without any are dropped. Just one path ends in a whole token
at every byte. States get their rows of the transition table when a word first meets them. ``encode_word`` goes over
the bytes of a word once, by table look-ups, and then reads the arcs of the one path back from its end. The table has
a bounded size: a full one is emptied, within a word too, and fills again, which changes no result. Decoding emits the
labels of the arcs.

**Words.** Texts are split by the published pattern. Its classes of characters are those of the library's own Unicode
tables, which are asked for each character when it is first met: a text with one that the library takes for another
class than ``regex`` or Python do is cut into words by the library.

Nulls and texts: a null text counts as empty and has no tokens; ids may repeat; other columns are not read. A model
in which two merges make the same token is refused.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from strandloom.llm.common import id_and_text, map_rows, small_batches

#: Fixed value: the published pattern that splits text before the merges; White_Space is what \s means there.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: White space by the pattern or by Python; marks of which a run after letters is one word of the pattern.
WHITE = {c for c in map(chr, range(0x3001)) if c.isspace() or regex.match(r"\p{White_Space}", c)}
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

#: Entries of a worker cache, and the longest string that is kept in one.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Transitions of the byte automaton, and read arcs, that a worker keeps.
TRANSITIONS, ARCS = 500_000, 200_000
#: Beside the bytes, a row of the table has its state's paths and the token that ends the path of what was read.
PATHS, LAST = 256, 257
#: Tokens below a node from which on the open arcs of a path are listed.
FEW = 6
SHIFT = 1 << FEW + 1  # so that what a path stands on is no negative number


NEVER = 1 << 60


def packed_path(node: int, at: int) -> int:
    """A path as one integer: its node, and the token it stands behind or the arcs that are open (as -2 - bits)."""
    return node << 20 | at + SHIFT


def disputed(char: str, pieces: tokenizers.pre_tokenizers.PreTokenizer) -> bool:
    """Whether the library's tables say another class of a character than those that split texts here.

    Unicode grows, and the library, ``regex`` and Python each have tables of their own. The library shows what it takes
    a character for by where it cuts around it: a letter goes with the letter before it, a number with the number, and
    other marks, but white space, with the mark behind it.
    """
    probe = f"a{char}!1{char}!"
    theirs = {span[0] for _, span in pieces.pre_tokenize_str(probe)}
    return theirs != {m.start() for m in regex.finditer(PATTERN, probe)} or char.isalpha() and 1 in theirs


def byte_symbols() -> dict[str, int]:
    """Symbol of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Labels:
    """The labels of a byte-level BPE file of the tokenizers library: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.symbols, self.vocab = byte_symbols(), self.spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.labels: list[bytes] = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for word, i in self.vocab.items():
            self.labels[i] = bytes(self.symbols[c] for c in word)
        for word, i in self.special.items():
            self.labels[i] = word.encode()
        lengths = np.array([len(x) for x in self.labels], np.int64)
        self.label_bytes, self.label_len = np.frombuffer(b"".join(self.labels), np.uint8), lengths
        self.label_start = np.cumsum(lengths) - lengths

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, one after the other; what is no UTF-8 becomes the replacement character."""
        out, every = [], np.frombuffer(ids, "<u4")
        for at in range(0, len(every), 1 << 18):
            part = every[at : at + (1 << 18)]
            lengths = self.label_len[part]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(self.label_start[part] - ends + lengths, lengths)
            out.append(self.label_bytes[at].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class MergeGadgets:
    """The automaton over tokens, gadget by gadget: states and arcs are named by tokens."""

    def __init__(self, tokens: int):
        self.copied = [-1] * tokens  # state -> the state that it is a copy of
        self.holder = [-1] * tokens  # arc -> the arc whose holders got it
        self.made = [-1] * tokens  # state and arc -> the gadget that made them; bytes were there before
        self.taken: dict[int, int] = {}  # (state, arc) -> the gadget that took the arc away
        self.known: dict[int, bool] = {}
        self.gadgets = 0

    def add(self, a: int, b: int, c: int) -> None:
        """The gadget of the next merge (a, b) -> c."""
        if self.made[c] >= 0:
            raise ValueError(f"two merges make token {c}")
        self.taken[a << 20 | b] = self.gadgets
        self.copied[c], self.holder[c], self.made[c] = b, a, self.gadgets
        self.gadgets += 1

    def arc(self, state: int, arc: int) -> bool:
        """Whether the state has the arc after all gadgets."""
        key = state << 20 | arc
        if (held := self.known.get(key)) is None:
            if len(self.known) > ARCS:
                self.known.clear()
            held = self.known[key] = self.read(state, arc)
        return held

    def read(self, state: int, arc: int) -> bool:
        """The same, without keeping the answer."""
        made, taken = self.made, self.taken
        state_made, arc_made, before = made[state], made[arc], NEVER  # it is always asked what held before that gadget
        while True:
            key = state << 20 | arc
            if key in taken and taken[key] < before:
                return False
            if arc_made >= state_made:
                if arc_made < 0:
                    return True
                before, arc = arc_made + 1, self.holder[arc]  # the state got the arc if it held the other
                arc_made = made[arc]
            else:
                before, state = state_made, self.copied[state]  # the state is a copy of what another one was then
                state_made = made[state]


class MergeAutomaton(Labels):
    """The automaton over bytes, made deterministic on demand."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.vocab
        self.gadgets = MergeGadgets(len(self.labels))
        for merge in self.spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.gadgets.add(vocab[a], vocab[b], vocab[a + b])
        # The byte trie of the labels: nodes, and the tokens at or below each as a range of the sorted ones.
        self.sorted = sorted(vocab.values(), key=self.labels.__getitem__)
        self.trie: list[dict[int, int]] = [{}]  # node -> byte -> node
        self.whole: list[int] = [-1]  # node -> the token whose label ends there
        self.low, self.high = [0], [len(self.sorted)]
        for place, token in enumerate(self.sorted):
            node = 0
            for byte in self.labels[token]:
                below = self.trie[node].get(byte)
                if below is None:
                    below = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.whole.append(-1)
                    self.low.append(place)
                    self.high.append(place)
                node = below
                self.high[node] = place + 1
            self.whole[node] = token
        self.sizes, self.codes = [len(x) for x in self.labels], [struct.pack("<I", i) for i in range(len(self.labels))]
        self.split = regex.compile(PATTERN).findall
        self.pieces = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        self.agreed, self.odd = set(map(chr, range(128))), set()  # characters that have been met
        special = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut_special = regex.compile(f"({special})").split if special else None
        self.words = Cache(self._word)
        self.chunks = Cache(self._chunk)
        del self.spec
        self._empty()

    def _empty(self) -> None:
        """State 0 alone: one path, which stands before the first token and has read nothing."""
        self.start = {PATHS: (packed_path(0, -1),), LAST: -1}
        self.rows = {self.start[PATHS]: self.start}  # paths of a state -> its row: byte -> row of the next state
        self.transitions = 0
        self.open: dict[int, int] = {}  # token << 20 | node -> the arcs that are open there

    def _arcs(self, at: int, node: int) -> int:
        """The arcs of the state behind a token that go on at or below a node, as bits."""
        key = at << 20 | node
        bits = self.open.get(key)
        if bits is None:
            arc, bits = self.gadgets.read, 0
            for i, token in enumerate(self.sorted[self.low[node] : self.high[node]]):
                if at < 0 or arc(at, token):
                    bits |= 1 << i
            self.open[key] = bits
        return bits

    def _move(self, row: dict, byte: int) -> dict:
        """The row of the next state by a byte: subset construction, once for each pair.

        Where few tokens are left below a node, a path has the arcs that are still open instead of the token it stands
        behind: paths with the same open arcs are the same, and without any are dead.
        """
        low, high, live, last = self.low, self.high, [], -1
        for path in row[PATHS]:
            node, at = path >> 20, (path & 0xFFFFF) - SHIFT
            below = self.trie[node].get(byte)
            if below is None:
                continue
            token, left = self.whole[below], high[below] - low[below]
            if left > FEW:
                if token >= 0 and (at < 0 or self.gadgets.arc(at, token)):
                    last = token
                live.append(packed_path(below, at))
                continue
            bits = (-2 - at) >> low[below] - low[node] & (1 << left) - 1 if at < -1 else self._arcs(at, below)
            if token >= 0 and bits & 1:
                last = token
                bits ^= 1
            if bits:
                live.append(packed_path(below, -2 - bits))
        paths = (*live, packed_path(0, last))
        to = self.rows.get(paths)
        if to is None:
            to = self.rows[paths] = {PATHS: paths, LAST: last}
        self.transitions += 1
        row[byte] = to
        return to

    def packed(self, word: bytes) -> bytes:
        """Ids on the one path of word: every byte is one transition, then the arcs are read back from the end."""
        if self.transitions > TRANSITIONS:
            self._empty()
        row, ends = self.start, []
        add = ends.append
        for byte in word:
            try:
                row = row[byte]
            except KeyError:
                row = self._move(row, byte)
                if self.transitions > TRANSITIONS:  # the table begins anew with the state that is reached
                    self._empty()
                    row = self.rows.setdefault(row[PATHS], {PATHS: row[PATHS], LAST: row[LAST]})
            add(row[LAST])
        codes, sizes, at, ids = self.codes, self.sizes, len(word), []
        while at:
            token = ends[at - 1]
            ids.append(codes[token])
            at -= sizes[token]
        ids.reverse()
        return b"".join(ids)

    def encode_word(self, word: bytes) -> list[int]:
        return array("I", self.packed(word)).tolist()

    def _word(self, word: str) -> bytes:
        return self.packed(word.encode())

    def _plain(self, text: str) -> bytes:
        word = text.rstrip(MARKS)
        if word.isalpha():
            return self.words[word] + self.words[text[len(word) :]] if word != text else self.words[text]
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a space and what follows up to the next one; None where the split may not fall before that space."""
        if chunk.isalpha():
            return self.packed(b" " + chunk.encode())
        if not chunk or chunk[0] in WHITE or any(s in chunk for s in self.special):
            return None
        above, feed, below = chunk.partition("\n")
        if feed and above and below and above[-1] not in WHITE and below[0] not in WHITE:  # a lone line feed is a word
            return self.chunks[above] + self.words[feed] + self._plain(below)
        word = chunk.rstrip(MARKS)
        if word != chunk and word.isalpha():
            return self.chunks[word] + self.words[chunk[len(word) :]]
        return self._plain(" " + chunk)

    def _disputed(self, text: str) -> bytes:
        """Ids of a text in which the tables of characters differ: the library cuts it into words."""
        return b"".join(self.words[bytes(map(self.symbols.__getitem__, p)).decode()] for p, _ in self.pieces.pre_tokenize_str(text))

    def encode_plain(self, text: str) -> bytes:
        """The same as encode, but special strings are taken as text."""
        if not any(s in text for s in self.special):
            return self.encode(text)
        return self._disputed(text) if self._odd(text) else self._plain(text)

    def _odd(self, text: str) -> bool:
        """Whether a text has a character whose class is disputed; each is asked for once."""
        if text.isascii():
            return False
        new = set(text) - self.agreed
        odd = {c for c in new if c in self.odd or disputed(c, self.pieces)}
        self.odd |= odd
        self.agreed |= new - odd
        return bool(odd)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; special strings become their own ids."""
        if self._odd(text):
            special = self.special
            parts = (p for p in (self.cut_special(text) if self.cut_special else [text]) if p)
            return b"".join(struct.pack("<I", special[p]) if p in special else self._disputed(p) for p in parts)
        first, *chunks = text.split(" ")
        if chunks:
            parts = list(map(self.chunks.__getitem__, chunks))
            if None not in parts and not any(s in first for s in self.special):
                return self._plain(first) + b"".join(parts)
        if self.cut_special is None:
            return self._plain(text)
        special = self.special
        parts = (p for p in self.cut_special(text) if p)
        return b"".join(struct.pack("<I", special[p]) if p in special else self._plain(p) for p in parts)


class Cache(dict):
    """A worker's cache of fixed size: emptied when full, so its size does not follow the corpus."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


_LOADED: dict[str, MergeAutomaton] = {}
_LABELS: dict[str, Labels] = {}


def automaton(path: str) -> MergeAutomaton:
    """One compiled automaton to a worker process."""
    if path not in _LOADED:
        _LOADED[path] = MergeAutomaton(path)
    return _LOADED[path]


def labels(path: str) -> Labels:
    if path not in _LABELS:
        _LABELS[path] = Labels(path)
    return _LABELS[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers)."""
    small_batches(df.sparkSession)

    def kernel(batch: pa.RecordBatch) -> dict:
        ids = list(map(automaton(path).encode, batch.column(1).to_pylist()))
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return map_rows(id_and_text(df, id_col, text_col), kernel, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column text, decoded from ids; null ids decode to an empty text."""
    small_batches(encoded.sparkSession)

    def kernel(batch: pa.RecordBatch) -> dict:
        text = [labels(path).decode(x or b"") for x in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": batch.column(1), "ids": batch.column(2), "text": text}

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), kernel, "doc_id long, n_tokens long, ids binary, text string")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: what encode and then decode give, digested in one pass."""
    small_batches(df.sparkSession)

    def kernel(batch: pa.RecordBatch) -> dict:
        own = automaton(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column(1).to_pylist():
            ids = own.encode(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column(0)} | out

    return map_rows(id_and_text(df, id_col, text_col), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
