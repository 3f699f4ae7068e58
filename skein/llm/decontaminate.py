"""Benchmark passages in documents by a prefix-filtered set join with exact verification.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window), a window
into shingles of ``shingle`` words. A window is contained in a document only if all its shingles are,
so with shingles ordered by rarity in the corpus a prefix of one, the rarest, is all that has to be
joined. A hit of that shingle at word p with offset o in the window fixes the window to the words
from p - o on; it has to fit the document (positional and length bounds), its hash has to agree, and
at last its words are compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm.common import as_bytes, fresh, quoted, small_batches, steps
from skein.session import reliable

WINDOW, SHINGLE = 10, 5
#: Windows whose shingles one pass over the documents carries; a larger benchmark takes more passes.
PASS_WINDOWS = 500_000

#: A-Z to a-z, digits, a-z and all bytes beyond ASCII as they are, the rest to a space.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
_PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Hasher:
    """64-bit hashes of the words of a text by prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self._fit(_PIECE)

    def _fit(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word of ``data``, which has passed ``_WORDS``."""
        found, lo = [], 0
        while lo < len(data):
            hi = min(lo + _PIECE, len(data))
            if hi < len(data):  # cut at a space
                cut = data.rfind(b" ", lo, hi)
                hi = cut + 1 if cut >= 0 else (data.find(b" ", hi) + 1 or len(data))
            found.append((*self._piece(np.frombuffer(data, np.uint8, hi - lo, lo)), lo))
            lo = hi
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return (
            np.concatenate([h for h, _, _, _ in found]),
            np.concatenate([s + at for _, s, _, at in found]),
            np.concatenate([e + at for _, _, e, at in found]),
        )

    def _piece(self, b: np.ndarray):
        if len(b) >= len(self.up):
            self._fit(len(b))
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = b != 32
        edges = np.flatnonzero(np.diff(inside))
        s, e = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * self.up[: len(b)], out=sums[1:])
        h = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= _ODD
        return h ^ (h >> np.uint64(32)), s, e


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _STEP + words[j : j + n]
    return out ^ (out >> np.uint64(31))


@dataclass
class Windows:
    """Windows of the items of one pass; ``of`` has the items of each by number."""

    words: list[tuple[bytes, ...]]
    of: list[list[str]]
    #: by shingle size: hashes of shingles, and the (window, offset) of each shingle
    shingles: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)


def cut(items: list[tuple[str, str | None]], window: int, shingle: int) -> Windows:
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = tuple(words_of(text))
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            found[words[i : i + window]].add(item)
    out = Windows(list(found), [sorted(v) for v in found.values()])
    hasher, by = Hasher(), defaultdict(lambda: defaultdict(list))
    for k, words in enumerate(out.words):
        hashed, size = hasher(b" ".join(words))[0], min(shingle, len(words))
        for o, h in enumerate(rolled(hashed, size).tolist()):
            by[size][h].append((k, o))
    out.shingles = {size: dict(v) for size, v in by.items()}
    return out


class Probe:
    """Positions of words at which one of the given shingles begins."""

    def __init__(self, hashes) -> None:
        self.sorted = np.array(sorted(hashes), np.uint64)
        bits = min(max(len(self.sorted), 1).bit_length() + 7, 26)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.sorted >> self.shift] = True

    def __call__(self, rolled_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the shingle in sorted order)."""
        at = np.flatnonzero(self.seen[rolled_ >> self.shift])
        k = np.searchsorted(self.sorted, rolled_[at])
        ok = k < len(self.sorted)
        at, k = at[ok], k[ok]
        same = self.sorted[k] == rolled_[at]
        return at[same], k[same]


def _batches(texts: list[bytes], hasher: Hasher):
    """(first text, last text, data, hash, start, end, number of each text's first word)."""
    for lo, hi in steps(texts):
        data = b" ".join(texts[lo:hi]).translate(_WORDS)
        hashed, s, e = hasher(data)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        yield lo, hi, data, hashed, s, e, np.searchsorted(s, bounds)


def count_shingles(docs: DataFrame, text: str, windows: Windows) -> dict[int, dict[int, int]]:
    """How often each shingle of the windows occurs in all documents, by size and hash."""
    shared = docs.sparkSession.sparkContext.broadcast({size: sorted(v) for size, v in windows.shingles.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, probes = Hasher(), {size: Probe(v) for size, v in shared.value.items()}
        sums = {size: np.zeros(len(v), np.int64) for size, v in shared.value.items()}
        for batch in batches:
            for *_, hashed, s, _, first in _batches(as_bytes(batch.column(0)), hasher):
                for size, probe in probes.items():
                    at, k = probe(rolled(hashed, size))
                    last = first[np.searchsorted(first, at, "right")]
                    sums[size] += np.bincount(k[at + size <= last], minlength=len(sums[size]))
        for size, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size), pa.int32()), pa.array(some, pa.int64()), pa.array(total[some])], ["size", "k", "n"]
            )

    found = small_batches(docs).select(quoted(text)).mapInArrow(run, "size int, k bigint, n bigint").groupBy("size", "k").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {size: {} for size in shared.value}
    for r in found.collect():  # at most one row for each shingle of the pass
        out[r["size"]][shared.value[r["size"]][r["k"]]] = r["n"]
    return out


def prefixes(windows: Windows, counts: dict[int, dict[int, int]]) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """The rarest shingle of each window (ties: the smaller hash): size, hash, then windows and offsets.

    A window with a shingle that no document has occurs nowhere and is left out.
    """
    rarest: dict[int, tuple] = {}
    missing = set()
    for size, by in windows.shingles.items():
        for h, places in by.items():
            n = counts[size].get(h, 0)
            for k, o in places:
                if not n:
                    missing.add(k)
                rarest[k] = min(rarest.get(k, (n, h, o, size)), (n, h, o, size))
    out: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for k, (_, h, o, size) in rarest.items():
        if k not in missing:
            out.setdefault(size, {}).setdefault(h, []).append((k, o))
    return out


def match(docs: DataFrame, text: str, windows: Windows, prefix, out: str) -> DataFrame:
    """Add ``out``: n_words, the spans of words that windows cover, and the ids of items that occur."""
    shared = docs.sparkSession.sparkContext.broadcast((windows.words, windows.of, prefix))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, of, prefix = shared.value
        hasher = Hasher()
        lens = np.array([len(w) for w in words], np.int64)
        whole = np.array([_window_hash(hasher, w) for w in words], np.uint64)
        joined = [b" ".join(w) for w in words]
        probes = []
        for size, by in prefix.items():
            rows = [by[h] for h in sorted(by)]
            flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
            ends = np.cumsum([len(r) for r in rows])
            probes.append((size, Probe(by), flat, np.concatenate([[0], ends]).astype(np.int64)))
        for batch in batches:
            texts = as_bytes(batch)
            n_words = np.zeros(len(texts), np.int64)
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for lo, hi, data, hashed, s, e, first in _batches(texts, hasher):
                n_words[lo:hi] = np.diff(first)
                for size, probe, flat, ends in probes:
                    at, k = probe(rolled(hashed, size))
                    if not len(at):
                        continue
                    many = ends[k + 1] - ends[k]
                    at, pick = np.repeat(at, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[k], many)
                    window, begin = flat[pick, 0], at - flat[pick, 1]
                    doc = np.searchsorted(first, at, "right") - 1
                    fits = (begin >= first[doc]) & (begin + lens[window] <= first[doc + 1])
                    window, begin, doc = window[fits], begin[fits], doc[fits]
                    for w in np.unique(lens[window]).tolist():
                        one = lens[window] == w
                        rows = np.zeros(int(one.sum()), np.uint64)
                        for j in range(w):
                            rows = rows * _STEP + hashed[begin[one] + j]
                        good = rows == whole[window[one]]
                        for k_, b, d in zip(window[one][good].tolist(), begin[one][good].tolist(), doc[one][good].tolist()):
                            if b" ".join(data[s[b] : e[b + w - 1]].split()) == joined[k_]:
                                spans[lo + d].append((b - int(first[d]), b - int(first[d]) + w))
                                items[lo + d].update(of[k_])
            merged = [_merged(x) for x in spans]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(n_words),
                    pa.array([[{"first": a, "last": b} for a, b in m] for m in merged], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["n_words", "spans", "items"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"
    return small_batches(docs).withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(quoted(text)))


def _window_hash(hasher: Hasher, words: tuple[bytes, ...]) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for h in hasher(b" ".join(words))[0]:
        out = out * _STEP + h
    return out[0]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_passages(docs: DataFrame, items: DataFrame, out: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Add struct ``out``: n_words, spans (covered words, end exclusive), items (sorted ids as text).

    ``items`` is read in passes of items of at most ``pass_windows`` windows together, so what a task
    and the driver hold is bounded whatever the benchmark's size (a single longer item is a pass of
    its own). Null texts have no words. Items without words occur nowhere, a null item id is the
    empty string, rows of one id are one item. Repeated documents are judged alike; other columns
    pass through.
    """
    batch: list[tuple[str, str | None]] = []
    held = 0
    rows = items.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")), quoted(item_text)).toLocalIterator()
    found: DataFrame | None = None
    (part,) = fresh(docs, "passage_part")

    def add(got: list, base: DataFrame | None) -> DataFrame:
        windows = cut(got, window, shingle)
        prefix = prefixes(windows, count_shingles(docs, text, windows)) if windows.words else {}
        if base is None:
            return match(docs, text, windows, prefix, out)
        more = match(reliable(base), text, windows, prefix, part)
        a, b = F.col(out), F.col(part)
        return more.withColumn(out, F.struct(
            a["n_words"].alias("n_words"), F.array_sort(F.array_union(a["spans"], b["spans"])).alias("spans"),
            F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        )).drop(part)

    for item, words in rows:
        size = len(words_of(words))
        if held and held + size > pass_windows:
            found, batch, held = add(batch, found), [], 0
        batch.append((item, words))
        held += size
    return add(batch, found)


def _covered(spans):
    """Words under the union of sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["last"] - F.greatest(x["first"], s["end"]), F.lit(0))).alias("n"),
        F.greatest(s["end"], x["last"]).alias("end"),
    ))["n"]


def digest(found: DataFrame, out: str) -> DataFrame:
    """Doc ids with counts of words, hit words and items, the hash of the item ids, and the verdict."""
    hits = _covered(F.col(out)["spans"])
    return found.select(
        "doc_id",
        F.col(out)["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.size(F.col(out)["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col(out)["items"], ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any passage of an item, columns as they were."""
    (out,) = fresh(docs, "passages")
    return find_passages(docs, items, out).where(F.size(F.col(out)["items"]) == 0).select(*[quoted(c) for c in docs.columns])
