"""Secrets in whole texts, with multipart credentials linked by an interval join.

Strong candidates stand by themselves: ``assign`` (a password, secret, token or key that is given a value), ``access``
(an access identifier) and ``hex`` (a long hexadecimal run). Weak ones would flood a report if they did: account names,
short or unnamed keys, addresses. Each has a role: ``identifier``, ``secret`` or ``endpoint``; of the strong ones
``access`` is an identifier, the others are secrets. An interval join finds, for each weak candidate, the nearest part
of a complementary role within its scope: no blank line and at most ``reach`` code points between both. A weak
identifier is reported with a secret in scope, a weak secret with an identifier, an endpoint with both.

Candidates are sorted arrays of starts and ends with one coordinate for all texts of a batch, and the nearest parts on
either side come from ``searchsorted``, so a text with any number of candidates costs no pairs. All parts of a
credential are in one text, so nothing is shuffled. All patterns take linear time.

A null text counts as empty and has no spans. Ids may be null or repeat, every row is answered by itself, other columns
are not read, and an empty table gives no rows. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, small_batches

#: The strong kinds in the order in which they are listed.
STRONG = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LEAST_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

ROLES = ("identifier", "secret", "endpoint")
KINDS = (*STRONG, *ROLES)
#: Code points between two parts of one credential, at most.
REACH = 200
GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
IDENTIFIER = re.compile(
    rf"\b(?:(?:access[_-]?)?key[_-]?id|client[_-]?id|account(?:[_-]?(?:id|name))?|user(?:[_-]?(?:id|name))?|login|email){GIVEN}[A-Za-z0-9._@+-]{{3,}}"
    r"|\b(?-i:ASIA|AROA|AIDA)[A-Z0-9]{12,}", re.I | re.A,
)
SECRET = re.compile(
    rf"\b(?:pass(?:phrase|code|word|wd)?|pwd|pin|auth|credentials?|(?:private|secret|access|account|api)[_-]?key|client[_-]?secret|secret|signature|token)"
    rf"{GIVEN}([A-Za-z0-9+/_.=!@#$%^&*-]{{4,}})", re.I | re.A,
)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
ADDRESS = re.compile(
    r"\b[a-z][a-z0-9+]{1,20}://(?:(?P<user>[^\s/:@\"'<>]{1,256}):(?P<key>[^\s/@\"'<>]{1,256})@)?(?P<host>[^\s\"'<>]+)"
    rf"|\b(?:host(?:name)?|server|endpoint|base[_-]?url){GIVEN}[A-Za-z0-9.-]{{3,}}(?::[0-9]{{2,5}})?"
    r"|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b", re.I | re.A,
)
#: A run without a name is a candidate from this entropy on, in bits for each character.
LEAST_ENTROPY = 3.5
BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int]


def strong(text: str) -> dict[str, list[Span]]:
    """The strong spans of each kind, leftmost and without overlap within a kind."""
    given = ":" in text or "=" in text
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if given else [],
        "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def entropy(run: str) -> float:
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def unnamed(run: str) -> bool:
    """Whether a run may be a key: digits and letters of both cases, in no simple order."""
    return any(map(str.isdigit, run)) and any(map(str.islower, run)) and any(map(str.isupper, run)) and entropy(run) >= LEAST_ENTROPY


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that touch none of those that are taken, nor an earlier one of their own."""
    out: list[Span] = []
    taken, at, end = sorted(taken), 0, 0
    reached = [0]  # the furthest end of those before
    for _, e in taken:
        reached.append(max(reached[-1], e))
    for s, e in sorted(spans):
        while at < len(taken) and taken[at][0] < e:
            at += 1
        if s >= reached[at] and s >= end:
            out.append((s, e))
            end = e
    return out


def weak(text: str, found: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The weak candidates of each role, apart from strong spans and from one another."""
    whole = [s for spans in found.values() for s in spans]
    addresses = list(ADDRESS.finditer(text)) if "://" in text or ":" in text or "=" in text else []
    named = [m for m in addresses if m["user"]]
    names = [m.span() for m in IDENTIFIER.finditer(text)]
    if not (names or named or found["access"]):  # without an identifier nothing weak is reported
        return {}
    names = apart(names + [m.span("user") for m in named], whole)
    ends = apart([m.span("host") if m["host"] else m.span() for m in addresses], whole + names)
    keys = [m.span("key") for m in named] + [m.span() for m in SECRET.finditer(text)]
    keys = apart(keys, whole + names + ends)
    bare = [m.span() for m in BARE.finditer(text) if unnamed(m[0])]
    return {"identifier": names, "secret": sorted(keys + apart(bare, whole + names + ends + keys)), "endpoint": ends}


class Parts:
    """The parts of one role in all texts of a batch, by place: the right side of the interval join."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.start, self.end, self.block = np.array(sorted(spans), np.int64).reshape(-1, 3).T

    def nearest(self, start: np.ndarray, end: np.ndarray, block: np.ndarray, reach: int) -> np.ndarray:
        """The start of the nearest part in scope of each span, or -1: the one before it or the one after it."""
        best, out = np.full(len(start), reach + 1), np.full(len(start), -1)
        if not len(self.start):
            return out
        after = np.searchsorted(self.start, start)
        for at in (after - 1, after):
            inside = (at >= 0) & (at < len(self.start))
            at = np.clip(at, 0, len(self.start) - 1)
            gap = np.maximum(0, np.maximum(self.start[at] - end, start - self.end[at]))
            closer = inside & (self.block[at] == block) & (gap < best)
            best, out = np.where(closer, gap, best), np.where(closer, self.start[at], out)
        return out


def scan(texts: list[str], reach: int = REACH) -> list[list[tuple[str, int, int, int | None]]]:
    """(kind, start, end, partner) of each text, by start and kind; partner is the start of the part that a weak one is linked to."""
    rows: list[list] = []
    parts: dict[str, list] = {role: [] for role in ROLES}  # all that can complete a credential
    asked: dict[str, list] = {role: [] for role in ROLES}  # weak candidates: start, end, block, text, offset of the text
    base = blocks = 0
    for number, text in enumerate(texts):
        found = strong(text)
        rows.append([(kind, s, e, None) for kind in STRONG for s, e in found[kind]])
        if candidates := weak(text, found):
            cuts = [m.start() for m in BLANK.finditer(text)]
            place = lambda s, e, cuts=cuts, base=base, blocks=blocks: (base + s, base + e, blocks + int(np.searchsorted(cuts, s)))
            for kind in STRONG:
                parts["identifier" if kind == "access" else "secret"] += [place(*s) for s in found[kind]]
            for role, spans in candidates.items():
                placed = [place(*s) for s in spans]
                parts[role] += placed
                asked[role] += [(*p, number, base) for p in placed]
            blocks += len(cuts) + 1
        base += len(text) + 1
    joined = {role: Parts(merged(spans)) for role, spans in parts.items()}
    for role, needs in (("identifier", ("secret",)), ("secret", ("identifier",)), ("endpoint", ("identifier", "secret"))):
        if asked[role]:
            start, end, block, number, offset = np.array(asked[role], np.int64).T
            partners = [joined[other].nearest(start, end, block, reach) for other in needs]
            kept = np.logical_and.reduce([p >= 0 for p in partners])
            for s, e, n, o, p in zip(*(x[kept].tolist() for x in (start, end, number, offset, partners[0])), strict=True):
                rows[n].append((role, s - o, e - o, p - o))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return [sorted(row, key=lambda r: (r[1], order[r[0]], r[2])) for row in rows]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of one role without overlaps, so that their ends are in the order of their starts."""
    out: list[tuple[int, int, int]] = []
    for s, e, block in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, block))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,partner:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("partner", pa.int32())]))


def secret_spans(df: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, partner) of every row."""
    small_batches(df.sparkSession)
    names = ("kind", "start", "end", "partner")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, span, strict=True)) for span in row] for row in scan(batch.column(1).to_pylist(), reach)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the strong spans), spans (all, as a text)."""
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return spans.select("doc_id", *map(number, STRONG), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
