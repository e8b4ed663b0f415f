"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot holds one bit for each
language, so a look-up of an n-gram in all filters is an AND of a few words and
gives the set of languages that know it. A document's hits per language are
its counts over all n-grams, less what the filters' false-positive rates explain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneflow.llm.base import held_out, ship_code, stored

UNKNOWN = "und"
FEW = 10  # sampled texts of a language below which each of their n-grams counts
_GAP = np.uint64(0x20)


@cache
def _letter_table() -> np.ndarray:
    """For each code point, its lower-case code point if it is a letter, else the gap."""
    table = np.full(0x110000, int(_GAP), dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the n-grams of the lower-cased words, one gap at either end of a word; none without a letter."""
    codes = _letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")].astype(np.uint64)
    codes = np.concatenate(([_GAP], codes, [_GAP]))
    gap = codes == _GAP
    keep = ~(gap & np.concatenate(([False], gap[:-1])))
    codes, gap = codes[keep], gap[keep]
    inner = np.concatenate(([0], np.cumsum(gap)))
    found = []
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for i in range(n):
            h = (h + codes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # no gap within: those from the second to the last but one
        clean = inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] == 0 if n > 2 else np.ones(m, dtype=bool)
        found.append(h[clean])
    return mix64(np.concatenate(found)) if found and not gap.all() else np.empty(0, dtype=np.uint64)


class Filters(NamedTuple):
    """`slots` is (2^bits, words of 64 languages); `false_rate` the share of n-grams a language's filter wrongly knows."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    hashes: int
    sizes: tuple[int, ...]


def positions(grams: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(i) * step) & mask).astype(np.int64) for i in range(hashes)]


def build(known: dict[str, np.ndarray], bits: int, hashes: int, sizes: tuple[int, ...]) -> Filters:
    languages = sorted(known)
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    rates = np.zeros(len(languages))
    for i, language in enumerate(languages):
        word, bit = i // 64, np.uint64(1 << (i % 64))
        for p in positions(known[language], bits, hashes):
            slots[p, word] |= bit
        fill = np.count_nonzero(slots[:, word] & bit) / (1 << bits)
        rates[i] = fill**hashes
    return Filters(languages, slots, rates, hashes, sizes)


def count_hits(filters: Filters, grams: np.ndarray) -> np.ndarray:
    """N-grams each language knows, less the expected false positives among those it does not."""
    bits = int(filters.slots.shape[0]).bit_length() - 1
    masks = None
    for p in positions(grams, bits, filters.hashes):
        masks = filters.slots[p] if masks is None else masks & filters.slots[p]
    hits = np.array(
        [np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(filters.languages))],
        dtype=float,
    )
    return np.maximum(0.0, (hits - filters.false_rate * len(grams)) / (1 - np.minimum(filters.false_rate, 0.999)))


def decide(filters: Filters, text: str | None) -> tuple[str, float]:
    """The language with most corrected hits, the earlier name on ties, and its lead over the runner-up."""
    grams = ngram_hashes(text, filters.sizes) if text else np.empty(0, dtype=np.uint64)
    if not len(grams) or not filters.languages:
        return UNKNOWN, 0.0
    hits = count_hits(filters, grams)
    best = int(np.argmax(hits))
    total = float(np.sum(hits))
    return filters.languages[best], float(min(1.0, hits[best] / total)) if total else 0.0


def learn(
    docs: DataFrame,
    per_language: int = 400,
    longest: int = 50_000,
    least_docs: int = 3,
    most_languages: int = 1024,
    bits: int = 19,
    hashes: int = 2,
    sizes: tuple[int, ...] = (3, 4),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Filters:
    """Filters of the n-grams that at least `least_docs` sampled documents of a language have.

    The sample is `per_language` different texts per language, of longer ones a
    window of `longest` characters, chosen by a hash of the text, among rows
    that are not held out and have a language. These bounds hold at any size of
    the corpus. Of a language with fewer than `FEW` sampled texts every n-gram
    counts, so that none is left out for being rare. More than
    `most_languages` languages, or none, is an error or an empty model.
    A rank in each language needs no more than its candidates: rows are first
    thinned by hash to somewhat more than the sample.
    """
    ship_code(docs.sparkSession)
    hashed = F.xxhash64(F.lit("sample"), "text")
    start = F.when(F.length("text") > longest, F.pmod(hashed, F.length("text") - longest)).otherwise(F.lit(0)).cast("int") + 1
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    ).where(F.col("text").rlike(r"\p{L}"))
    # Copies of a text are drawn together, so chances go by different texts; their number is known to a few percent.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(hashed, 0.02).alias("n")).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"{len(counts)} languages, more than {most_languages}")
    if not counts:
        return build({}, bits, hashes, sizes)
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.create_map(*[
        x for lang, n in counts.items()
        for x in (F.lit(lang), F.lit(min(1.0, 1.2 * (per_language + 4 * math.sqrt(per_language) + 16) / max(n, 1))))
    ])
    drawn = rows.withColumn("u", draw).where(F.col("u") < F.element_at(chance, F.col("lang")))
    drawn = drawn.groupBy("lang", "u", hashed.alias("h")).agg(F.first(F.substring("text", start, F.lit(longest))).alias("text"))
    rank = Window.partitionBy("lang").orderBy("u", "h")
    sample = stored(drawn.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= per_language), "language-sample")
    few = [r["lang"] for r in sample.groupBy("lang").count().where(F.col("count") < FEW).collect()]
    least = F.when(F.col("lang").isin(few), 1).otherwise(least_docs) if few else F.lit(least_docs)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = np.unique(ngram_hashes(text, sizes))
                yield pd.DataFrame({"lang": lang, "gram": found.view(np.int64)})

    known = (
        sample.select("lang", "text").mapInPandas(grams, "lang string, gram long")
        .groupBy("lang", "gram").count().where(F.col("count") >= least).select("lang", "gram").toPandas()
    )
    return build(
        {lang: g["gram"].to_numpy().view(np.uint64) for lang, g in known.groupby("lang")}, bits, hashes, sizes
    )


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row.

    Null texts and texts without a letter are `und` with score 0; so is every
    text when nothing was learned. The score is the winner's share of all
    corrected hits. Texts in none of the languages go to the first name with
    score 0. Repeated rows are each answered; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: 2^bits slots

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            answers = [decide(model, text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "lang_pred": [a[0] for a in answers],
                "score": [a[1] for a in answers],
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(predict, "doc_id long, lang_pred string, score double")
