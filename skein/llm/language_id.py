"""Language identification by compression against one raw-content dictionary per language.

A text is cut into blocks; each block is encoded with zstandard once per language, with that
language's sample as raw-content dictionary, and the language of the smallest total wins. Blocks
keep the dictionary in use over the whole of a long text, where the text's own past would otherwise
take its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import fresh, held_out, quoted, small_batches

#: Documents sampled per language, bytes taken from each, and bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 400, 512, 32 << 10
#: Documents drawn per language for each one sampled, as some have no letter.
DRAW = 4
#: Dictionaries are cut to the smallest one, as nearer content is cheaper to refer to, but not below this.
LEAST_DICT_BYTES = 8 << 10
BLOCK_BYTES = 1 << 10
#: A text below SHORT_BYTES is encoded SUFFIXES times, from other places on: whole bytes are too
#: coarse a measure of a few words. PAD follows, without which the encoder stores few bytes raw.
SHORT_BYTES, SUFFIXES, PAD = 256, 16, b" " * 256
LEVEL = 9
#: A document is rejected if the runner-up is not larger by this share of the best size.
MIN_MARGIN = 0.002

_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class Model:
    """Sorted languages and the sample text of each."""

    dictionaries: tuple[tuple[str, bytes], ...]


def normal(text: str) -> bytes:
    """Lower case, with every run of ASCII other than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def fit(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    lang: str = "lang",
    order: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """Collect a bounded sample of each language: ``sample_docs`` documents by the hash of their id.

    At most ``sample_docs`` times ``SAMPLE_BYTES`` characters of a language reach the driver, from
    the middle of each sampled text; the languages themselves are as few as a person names. About
    ``DRAW`` times as many documents are ranked, so a language that holds most rows costs no more than
    another. Documents without a letter or a language are not learnt.
    """
    docs = docs.where(train & quoted(lang).isNotNull())
    piece = F.length(quoted(text))
    piece = F.substring(quoted(text), F.greatest((piece - SAMPLE_BYTES) / 2, F.lit(0)).cast("int") + 1, F.lit(SAMPLE_BYTES))
    # hashes below this draw a few times the sample from a language, so that what is ranked is bounded
    counts = docs.groupBy(quoted(lang).alias("known")).count().select(
        "known", F.least(F.lit(1.0), F.lit(float(DRAW * sample_docs)) / F.col("count")).alias("share")
    )
    deal = F.xxhash64(quoted(order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("deal", "piece"))
    rows = (
        docs.join(F.broadcast(counts), quoted(lang) == F.col("known"))
        .where((F.pmod(deal, F.lit(1 << 30)) < F.col("share") * (1 << 30)) & quoted(text).rlike(r"\p{L}"))
        .select(F.col("known").alias("lang"), deal.alias("deal"), piece.alias("piece"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= sample_docs)
        .select("lang", "rank", "piece")
        .collect()
    )
    parts: dict[str, dict[bytes, None]] = {}
    for r in sorted(rows):
        parts.setdefault(r.lang, {})[normal(r.piece)] = None
    whole = {k: b" ".join(parts[k])[:DICT_BYTES] for k in sorted(parts)}
    most = max(LEAST_DICT_BYTES, min(map(len, whole.values()), default=0))
    return Model(tuple((k, v[:most]) for k, v in whole.items()))


def _coders(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, sample in model.dictionaries:
        # a raw-content dictionary has to hold a few bytes
        content = zstandard.ZstdCompressionDict(sample.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(
            dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False,
        ))
    return out


def sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the encoded text by language."""
    data = normal(text)
    if len(data) < SHORT_BYTES:
        blocks = [data[i:] + PAD for i in range(0, len(data), -(-len(data) // SUFFIXES) or 1)]
    else:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in coders]


def decide(text: str | None, model: Model, coders, min_margin: float) -> tuple[str, float, bool]:
    if not text or not model.dictionaries or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    by = sorted(zip(sizes(text, coders), (k for k, _ in model.dictionaries)))
    best, lang = by[0]
    if len(by) == 1:
        return lang, 1.0, False
    margin = (by[1][0] - best) / max(best, 1)
    # the share of probability left to the best when each byte saved in a hundred counts alike
    return lang, 1 / (1 + sum(math.exp(-100 * (s - best) / max(best, 1)) for s, _ in by[1:])), margin < min_margin


def identify(docs: DataFrame, model: Model, text: str = "text", min_margin: float = MIN_MARGIN, out: str = "language") -> DataFrame:
    """Add a struct ``out`` of lang_pred, score and rejected to every row.

    ``lang_pred`` is the language whose dictionary encodes the whole text smallest (ties: the first
    by code point), ``und`` where the text is null, empty or without a letter, or where nothing was
    learnt. ``rejected`` marks those and texts whose margin is below ``min_margin``; the guess stays.
    Repeated rows are judged alike, other columns pass through whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders = _coders(shared.value)
        for texts in batches:
            rows = [decide(t, shared.value, coders, min_margin) for t in texts.to_pylist()]
            langs, scores, rejected = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["lang_pred", "score", "rejected"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judge = F.arrow_udf(run, RESULT).asNondeterministic()
    return small_batches(docs).withColumn(out, judge(quoted(text)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents that have a language with a margin, columns as they were."""
    (out,) = fresh(docs, "language")
    model = fit(docs, ~held_out("doc_id"))
    return identify(docs, model, out=out).where(~F.col(out)["rejected"]).select(*[quoted(c) for c in docs.columns])
