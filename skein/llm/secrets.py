"""Secrets in texts: patterns that tell alone, and weak parts that tell only together.

An access identifier, a secret and an endpoint of one credential often stand apart without a key
word. Each is a weak candidate; identifiers and secrets are interval-joined within a scope (so many
code points between them), endpoints with the pairs found, and only what has its complement is
reported. The parts of a document lie in one row, so the join sorts them there and nothing is
shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import quoted, small_batches

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 200

_NAMES = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT = re.compile(r"[0-9]")
#: Tokens that may be a weak identifier or secret, however long; what they hold decides.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.A)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans that count alone: assignments of 12 characters or more, access ids of 18, hex runs of 16."""
    found: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that overlap no base span."""
    found: list[Span] = []
    if "://" in text:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    if _DIGIT.search(text):
        for m in _TOKEN.finditer(text):
            t = m.group()
            if not any(c.isdigit() for c in t):
                continue
            upper, lower = any(c.isupper() for c in t), any(c.islower() for c in t)
            if upper and not lower and t.isalnum():
                found.append(("weak_id", *m.span()))
            elif lower and len(t) >= 20 and (upper or t.isalnum()):
                found.append(("weak_secret", *m.span()))
    taken = Near([(a, b) for _, a, b in base])
    return [x for x in found if not taken.within(x[1], x[2], -1)]


class Near:
    """Intervals sorted by start, asked whether one lies within a distance."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def within(self, start: int, end: int, gap: int) -> bool:
        """Whether an interval has at most ``gap`` code points between it and [start, end); -1: overlaps it."""
        i = bisect_right(self.starts, start)
        if i and self.ends[i - 1] >= start - gap:
            return True
        i = bisect_left(self.starts, start)
        return i < len(self.starts) and self.starts[i] <= end + gap


def link(base: list[Span], weak: list[Span], scope: int) -> list[Span]:
    """Weak spans whose complement is in scope.

    Identifiers (weak ones and access ids) and secrets (weak ones, assignments and hex runs) need one
    another; an endpoint needs a linked identifier and a linked secret.
    """
    of = lambda spans, *kinds: [(a, b) for k, a, b in spans if k in kinds]
    ids = of(weak, "weak_id") + of(base, "access")
    secrets = of(weak, "weak_secret") + of(base, "assign", "hex")
    near_id, near_secret = Near(ids), Near(secrets)
    linked_ids = Near([x for x in ids if near_secret.within(*x, scope)])
    linked_secrets = Near([x for x in secrets if near_id.within(*x, scope)])
    need = {"weak_id": (near_secret,), "weak_secret": (near_id,), "endpoint": (linked_ids, linked_secrets)}
    return [x for x in weak if all(n.within(x[1], x[2], scope) for n in need[x[0]])]


def find(text: str | None, scope: int = SCOPE) -> list[Span]:
    """All spans by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    base = base_spans(text)
    weak = weak_spans(text, base)
    return sorted(base + (link(base, weak, scope) if weak else []), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, out: str, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Add ``out``, the array of (kind, first, last) of secrets, code points, end exclusive.

    Null and empty texts have none. Ties in position go by kind. Repeated rows are scanned alike;
    other columns pass through.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(
                [[{"kind": k, "first": a, "last": b} for k, a, b in find(t, scope)] for t in texts.to_pylist()],
                pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])),
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "array<struct<kind: string, first: bigint, last: bigint>>"
    return small_batches(docs).withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(quoted(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def digest(found: DataFrame, out: str) -> DataFrame:
    """Counts of base kinds, the hash of the base spans, and all spans as text."""
    spans = F.col(out)
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
