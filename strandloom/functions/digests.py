"""A 32-bit murmur3 digest that is built up value by value.

A state is a struct of the mixed bits and the number of bytes so far, so digests of several columns are chained by
giving the state of one to the next, in the same or in another job. A text counts as its length in bytes (64 bits), its
bytes in words of four from the left, the first byte highest, and a last word of those left over, 0 if there are none;
a byte from 128 on sets all higher bits of its word, as it is taken with its sign. A 64-bit number is its high word and
its low word. A null value or state gives null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of murmur3: multipliers of a word, what is added to the state, multipliers of the end.
C1, C2, ADDED, LAST_1, LAST_2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35

STATE = "h long, n long"


def mixed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (uint32) after one word each."""
    k = words * np.uint32(C1)
    k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(C2)
    h = h ^ k
    return (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(ADDED)


def finished(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Digests of states; n counts bytes."""
    r = h ^ n.astype(np.uint32)
    r = (r ^ r >> np.uint32(16)) * np.uint32(LAST_1)
    r = (r ^ r >> np.uint32(13)) * np.uint32(LAST_2)
    return r ^ r >> np.uint32(16)


def text_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, nth: int) -> np.ndarray:
    """The nth word of each text; none has fewer words than that, but for the last one it may have fewer bytes."""
    out = np.zeros(len(starts), np.uint32)
    for byte in range(4 * nth, 4 * nth + 4):
        there = byte < sizes
        signed = data[np.minimum(starts + byte, max(len(data) - 1, 0))].astype(np.int8).astype(np.int32).view(np.uint32) if len(data) else out
        out = np.where(there, out << np.uint32(8) | signed, out)
    return out


def after_texts(h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after a text each, word by word for all rows at once, and the bytes that were counted."""
    order = np.argsort(-sizes, kind="stable")  # rows that still have words come first
    h, starts, sizes = h[order], starts[order], sizes[order]
    for half in (sizes >> 32, sizes & 0xFFFFFFFF):
        h = mixed(h, half.astype(np.uint32))
    many = sizes // 4 + 1
    left = np.searchsorted(-many, -np.arange(many.max(initial=0)), side="left")
    for nth, rows in enumerate(left.tolist()):
        h[:rows] = mixed(h[:rows], text_words(data, starts[:rows], sizes[:rows], nth))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return h[back], (4 * (many + 2))[back]


def _states(state: pa.StructArray, value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = state.field(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
    return h, state.field(1).fill_null(0).to_numpy(zero_copy_only=False), ~(state.is_null().to_numpy(zero_copy_only=False) | value.is_null().to_numpy(zero_copy_only=False))


def _made(h: np.ndarray, n: np.ndarray, known: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], ["h", "n"], mask=pa.array(~known))


def start(seed: int = 0) -> Column:
    """The state before any value."""
    return F.struct(F.lit(seed & 0xFFFFFFFF).cast("long").alias("h"), F.lit(0).cast("long").alias("n"))


def with_text(state: Column, value: Column) -> Column:
    """The state after a text or binary value."""

    @F.arrow_udf(STATE)
    def update(state: pa.Array, value: pa.Array) -> pa.Array:
        h, n, known = _states(state, value)
        value = value.cast(pa.large_binary()).fill_null(b"")
        buffers = value.buffers()
        cuts = np.frombuffer(buffers[1], np.int64)[value.offset : value.offset + len(value) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        h, more = after_texts(h, data, cuts[:-1], np.diff(cuts))
        return _made(h, n + more, known)

    return update(state, value.cast("binary"))


def _with_number(state: Column, value: Column, words: int) -> Column:
    @F.arrow_udf(STATE)
    def update(state: pa.Array, value: pa.Array) -> pa.Array:
        h, n, known = _states(state, value)
        bits = value.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for shift in (32, 0)[-words:]:
            h = mixed(h, (bits >> np.uint64(shift) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return _made(h, n + 4 * words, known)

    return update(state, value.cast("long"))


def with_long(state: Column, value: Column) -> Column:
    """The state after a 64-bit number."""
    return _with_number(state, value, 2)


def with_int(state: Column, value: Column) -> Column:
    """The state after the low 32 bits of a number."""
    return _with_number(state, value, 1)


def digest(state: Column) -> Column:
    """The digest of a state, 0 to 2^32 - 1."""

    @F.arrow_udf("long")
    def value(state: pa.Array) -> pa.Array:
        h, n, known = _states(state, state)
        return pa.array(finished(h, n).astype(np.int64), mask=~known)

    return value(state)
