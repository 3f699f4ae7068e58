"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample, documents drawn from the whole corpus the
unlabelled one. With the class prior p the risk of a scorer g is

    p * E_pos[loss(g)] + max(0, E_all[loss(-g)] - p * E_pos[loss(-g)])

with the logistic loss; where the second part falls below zero, as the positives are fitted better
than the data allow, the step climbs back on it. The scorer is linear in log counts of words and word
stems whose share of documents differs between the two samples, in whether they come again, and in the
log length of the text. Stems tell where a toxic word occurs in many forms, each of them too rare to
be learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm.common import as_bytes, drawn, held_out, quoted, small_batches
from skein.llm.decontaminate import _ODD, Hasher, Probe, _batches
from skein.session import reliable

#: Documents of each sample the classifier is fitted on, and words and stems it may weigh.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 512
#: A word is weighed if the shares of documents with it lie this many standard errors apart.
MIN_Z = 5.0
#: Share of toxic documents where the labels do not tell (no document labelled as not toxic).
PRIOR = 0.1
#: Bytes of the stems that are weighed besides whole words; only longer words have them.
STEMS = (5, 6, 7)
STEPS, RATE, DECAY, CLIMB = 600, 0.05, 1e-3, 1.0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # one for each word, one for each that comes again, then length, then bias


def _risk_steps(pos: np.ndarray, every: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights (bias last) that minimise the corrected risk, by Adam over whole samples."""
    pos, every = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, every))
    w = np.zeros(pos.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    keep = np.ones_like(w)
    keep[-1] = 0
    for t in range(1, steps + 1):
        gp, gu = pos @ w, every @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_pos = prior * pos.T @ (sp - 1) / len(pos)
        d_neg = every.T @ su / len(every) - prior * pos.T @ sp / len(pos)
        g = d_pos + d_neg if negative >= 0 else -CLIMB * d_neg
        g = g + DECAY * keep * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _design(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.hstack([np.log1p(counts), counts > 1, np.log1p(n_words)[:, None] / 5])


def features(data: bytes, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its word) of all words and of the stems of longer ones."""
    data, found, words = np.frombuffer(data, np.uint8), [hashed], [np.arange(len(hashed))]
    for n in STEMS:
        longer = np.flatnonzero(end - start > n)
        stem = np.full(len(longer), n, np.uint64)
        for j in range(n):
            stem = (stem << np.uint64(8)) | data[start[longer] + j]
        for shift in (32, 29):
            stem = (stem ^ (stem >> np.uint64(shift))) * _ODD
        found.append(stem ^ (stem >> np.uint64(32)))
        words.append(longer)
    return np.concatenate(found), np.concatenate(words)


def _counts(texts: list[bytes], hasher: Hasher, probe: Probe | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each feature of the model occurs in each text, and the words of each text."""
    counts, n_words = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64)
    for lo, hi, *words, first in _batches(texts, hasher):
        n_words[lo:hi] = np.diff(first)
        if probe is not None:
            found, word = features(*words)
            at, k = probe(found)
            np.add.at(counts, (lo + np.searchsorted(first, word[at], "right") - 1, k), 1)
    return counts, n_words


def _sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(doc_id, positive) of both samples, by the hash of the id; held-out documents are in neither."""
    toxic = labels.where(~held_out("doc_id") & (F.col("toxic") == 1)).select("doc_id").distinct()
    ids = reliable(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    confirmed = reliable(ids.join(toxic, "doc_id", "left_semi"))
    deal = F.xxhash64("doc_id")
    pos = drawn(confirmed, deal, max_positive, confirmed.count())
    every = drawn(ids, deal, max_unlabelled, ids.count())
    return pos.withColumn("positive", F.lit(True)).unionByName(every.withColumn("positive", F.lit(False)))


def prior_of(labels: DataFrame, default: float = PRIOR) -> float:
    """Share of toxic rows among the labelled ones that are not held out."""
    row = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).agg(F.sum("toxic"), F.count("toxic")).first()
    return row[0] / row[1] if row[1] and 0 < row[0] < row[1] else default


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, min_z: float = MIN_Z) -> Model:
    """Fit on bounded samples of ``docs`` (doc_id, text); ``labels`` (doc_id, toxic) confirms positives.

    Word counts of the samples stay on the executors; the driver gets the chosen words and a row of
    at most ``max_features`` counts for each sampled document. Without a positive document nothing
    is learnt and every score is 0.
    """
    prior = prior_of(labels) if prior is None else prior
    chosen = reliable(_sample(docs, labels, max_positive, max_unlabelled))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi, *words, first in _batches(texts, hasher):
                found, word = features(*words)
                order = np.argsort(word, kind="stable")
                found, bounds = found[order].view(np.int64), np.searchsorted(word[order], first)
                for i in range(lo, hi):
                    some, n = np.unique(found[bounds[i - lo] : bounds[i - lo + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("positive").slice(i, 1), pa.array([some]), pa.array([n.astype(np.int32)]),
                        pa.array([int(first[i - lo + 1] - first[i - lo])]),
                    ], ["positive", "words", "n", "n_words"])

    # at most max_positive + max_unlabelled ids
    sampled = reliable(
        small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .mapInArrow(words, "positive boolean, words array<bigint>, n array<int>, n_words bigint", barrier=False)
    )
    sizes = {r[0]: r[1] for r in sampled.groupBy("positive").count().collect()}
    n_pos, n_all = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_all:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    a, b = F.col("a") / n_pos, F.col("b") / n_all
    mean = (F.col("a") + F.col("b")) / (n_pos + n_all)
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean) * (1 / n_pos + 1 / n_all) + 1e-12)
    top = (
        sampled.select("positive", F.explode("words").alias("word"))
        .groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
        .where((F.col("a") + F.col("b") > 2) & (z >= min_z))
        .orderBy(z.desc(), "word").limit(max_features).collect()
    )
    known = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for positive, w, n, n_words in zip(*[c.to_pylist() for c in batch.columns]):
                w, n = np.array(w, np.int64).view(np.uint64), np.array(n, np.int64)
                out = np.zeros(len(known), np.int64)
                _, i, j = np.intersect1d(known, w, assume_unique=True, return_indices=True)
                out[i] = n[j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([positive]), pa.array([out], pa.list_(pa.int64())), pa.array([n_words])], ["positive", "counts", "n_words"]
                )

    got = sampled.mapInArrow(rows, "positive boolean, counts array<bigint>, n_words bigint").toPandas()
    x = _design(np.array(got["counts"].tolist(), float).reshape(len(got), len(known)), got["n_words"].to_numpy(float))
    positive = got["positive"].to_numpy(bool)
    return Model(known, _risk_steps(x[positive], x[~positive], prior))


def score(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """Add ``out``, the estimated chance that the whole text is toxic.

    Null and empty texts get the chance of a text without words. Repeated rows score alike; other
    columns pass through and are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, hasher = shared.value, Hasher()
        probe = Probe(model.words) if len(model.words) else None
        for batch in batches:
            counts, n_words = _counts(as_bytes(batch), hasher, probe, len(model.words))
            if not len(model.weights):
                yield pa.array(np.zeros(len(batch)))
                continue
            g = _design(counts, n_words) @ model.weights[:-1] + model.weights[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(g, -500, 500))))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return small_batches(docs).withColumn(out, F.arrow_udf(run, "double").asNondeterministic()(quoted(text)))
