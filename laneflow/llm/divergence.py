"""Audit of how the sources of a language differ, by ranking count cells.

What a term is worth depends only on its counts, so terms are grouped into
cells of equal counts, and the divergence is worked out once per cell. For the
ranking of terms, cells are ranked by their values with the number of terms
above them; equal values are merged, and only cells that reach the first ranks
are expanded into terms. For pairs of sources, the terms that one of two
sources lacks are met as cells of the other alone; terms that both have are
met in blocks of sources, never as pairs of rows.

All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneflow.llm.base import ship_code, stored

__all__ = ["count_terms", "divergence"]

SCALE = 1_000_000_000
BLOCK = 128  # sources
HELD = 200_000  # counters a task holds before it passes them on
SLICE = 1 << 20  # bytes of a text split into words at once
SALTS = 16

UPPER = range(0x41, 0x5B)
# Bytes of terms stay, A to Z as small letters; every other byte is a blank. Characters above 0x7F have no other bytes.
LETTERS = bytes(b + 32 if b in UPPER else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

COUNTED = "lang string, source string, term binary, n long, docs long"
COUNTED_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _words(text: bytes) -> Iterator[list[bytes]]:
    clean, at = text.translate(LETTERS), 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE) if at + SLICE < len(clean) else -1
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents with them, and for every group a row with an empty term."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            n[b""] = docs[b""] = 0
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                schema=COUNTED_ARROW,
            )

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for words in _words(text):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n) - before + 1
            if held >= HELD:
                yield from passed()
                counts, held = {}, 0
    yield from passed()


def count_terms(
    documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3
) -> DataFrame:
    """lang, source, term, n, n_lang, first: occurrences of the terms that enough documents of the language have.

    Texts are counted where they lie; what is shuffled are counts. Every group
    also has a row with an empty term and no occurrences. `first` marks one
    row of every term of a language.
    """
    ship_code(documents.sparkSession)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")
    counted = documents.select(*filled, body).mapInArrow(_count, COUNTED)
    groups = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term").orderBy("source")
    whole = of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        groups.withColumn("term", F.col("term").cast("string"))
        .withColumn("n_lang", F.sum("n").over(whole))
        .withColumn("_docs", F.sum("docs").over(whole))
        .withColumn("first", F.row_number().over(of_term) == 1)
        .where((F.col("term") == "") | (F.col("_docs") >= least_docs))
        .select("lang", "source", "term", "n", "n_lang", "first")
    )


def _share(n: str, total: str) -> str:
    """1 + floor(SCALE * (n + 1) / (total + kinds)); null if a language has no terms."""
    return f"1 + (cast({n} + 1 AS DECIMAL(20, 0)) * {SCALE}) div cast(nullif({total} + kinds, 0) AS DECIMAL(20, 0))"


def _value(p: str, q: str) -> str:
    """floor((p - q)^2 / q). Shares are at most SCALE + 1, so squares of differences fit a BIGINT."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _groups(kept: DataFrame) -> DataFrame:
    """Per group: its total, its number of terms, the language's number of terms and total, the share of an absent
    term, and the source's place among those of the language."""
    langs = kept.groupBy("lang").agg(
        F.count_if(F.col("first") & (F.col("term") != "")).alias("kinds"), F.sum("n").alias("lang_total")
    )
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("own"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return (
        groups.join(langs, "lang")
        .withColumn("p0", F.expr(_share("0", "total")))
        .withColumn("at", at)
        .withColumn("block", F.floor(F.col("at") / BLOCK).cast("int"))
        .withColumn("at", (F.col("at") % BLOCK).cast("int"))
    )


def _top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    terms = kept.where((F.col("term") != "") & (F.col("n") > 0))
    cells = (
        terms.groupBy("lang", "source", "n", "n_lang")
        .agg(F.count("*").alias("terms"))
        .join(groups.select("lang", "source", "total", "kinds", "lang_total"), ["lang", "source"])
        .withColumn("p", F.expr(_share("n", "total")))
        .withColumn("q", F.expr(_share("n_lang", "lang_total")))
        .where("p > q")
        .withColumn("value", F.expr(_value("p", "q")))
        .select("lang", "source", "n", "n_lang", "value", "terms")
    )
    # Every value has a term at least, so no more than `top` values matter.
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = (
        cells.groupBy("lang", "source", "value")
        .agg(F.sum("terms").alias("terms"))
        .withColumn("nth", F.row_number().over(down))
        .withColumn("above", F.sum("terms").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("nth") <= top)
        .withColumn("above", F.col("above") - F.col("terms"))
        .where(F.col("above") < top)
        .select("lang", "source", "value", "above")
    )
    chosen = cells.drop("terms").join(values, ["lang", "source", "value"])
    same = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (
        terms.select("lang", "source", "n", "n_lang", "term")
        .join(chosen, ["lang", "source", "n", "n_lang"])
        .withColumn("nth", F.row_number().over(same))
        .where(F.col("nth") <= top)
        .withColumn("rank", F.col("above") + F.col("nth"))
        .where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


MET = "lang string, a int, b int, i int, j int, value long"
MET_ARROW = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.int64())])


def _dense(lists: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the block's sources and their shares of an absent term, a row per term; both are 1 where a source
    lacks the term, and then add nothing. And which sources have it."""
    offsets = np.asarray(lists.offsets)
    entries, base = lists.values, offsets[0]
    at, p, p0 = (np.asarray(entries.field(i)) for i in range(3))
    lengths = np.diff(offsets)[rows]
    spots = np.repeat(offsets[:-1][rows], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    width = int(at[spots].max()) + 1
    line = np.repeat(np.arange(len(rows)), lengths)
    own, absent = np.ones((2, len(rows), width), dtype=np.int64)
    own[line, at[spots]], absent[line, at[spots]] = p[spots], p0[spots]
    has = np.zeros((len(rows), width), dtype=bool)
    has[line, at[spots]] = True
    return own, absent, has


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sources i of block a and j of block b, summed over cells that both have: by how much the value of (i, j)
    differs from what the cells of each alone say."""
    sums: dict[tuple, np.ndarray] = {}

    def add(key, i, values):
        table = sums.setdefault(key, np.zeros((BLOCK, BLOCK), dtype=np.int64))
        table[i, : len(values)] += values

    def passed():
        for (lang, a, b), table in sums.items():
            i, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array(np.full(len(i), a, np.int32)), pa.array(np.full(len(i), b, np.int32)),
                 pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(table[i, j])], schema=MET_ARROW)

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in range(3)]))
        places: dict[tuple, list[int]] = {}
        for row, key in enumerate(keys):
            places.setdefault(key, []).append(row)
        times = np.asarray(batch.column(3))
        for (lang, a, b), rows in places.items():
            for chunk in np.array_split(np.array(rows), -(-len(rows) // 2000)):
                left, left0, has_left = _dense(batch.column(4), chunk)
                right, right0, has_right = _dense(batch.column(5), chunk)
                for x, x0, has, y, y0, key in (
                    (left, left0, has_left, right, right0, (lang, a, b)),
                    (right, right0, has_right, left, left0, (lang, b, a)),
                )[: 1 if a == b else 2]:
                    for i in range(x.shape[1]):
                        on = np.flatnonzero(has[:, i])
                        if len(on):
                            p, p0, q, q0 = x[on, i, None], x0[on, i, None], y[on], y0[on]
                            more = _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)
                            add(key, i, (more * times[chunk[on], None]).sum(axis=0))
        if len(sums) > 256:
            yield from passed()
            sums = {}
    yield from passed()


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Every source with every other source of its language: the value summed over all kept terms.

    With 0 for an absent term, the sum over terms t of f(g(t), h(t)) is that of
    f(g(t), 0), plus that of f(0, h(t)) - f(0, 0), plus, over the terms that
    both have, f(g(t), h(t)) - f(g(t), 0) - f(0, h(t)) + f(0, 0). The first two
    are sums over the cells of one source, the last over common terms only.
    """
    terms = kept.where((F.col("term") != "") & (F.col("n") > 0))
    own = groups.select("lang", "source", "total", "kinds", "p0", "own", "block", "at")
    cells = (
        terms.groupBy("lang", "source", "n")
        .agg(F.count("*").alias("terms"))
        .join(own, ["lang", "source"])
        .select("lang", "source", "terms", "p0", F.expr(_share("n", "total")).alias("p"))
        .unionByName(own.select("lang", "source", (F.col("kinds") - F.col("own")).alias("terms"), "p0", F.col("p0").alias("p")))
    )
    # A language may hold most sources: its cells are dealt out, and the other sources, a row each, go along.
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    alone = (
        salted.join(others, ["lang", "salt"])
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(
            F.sum(F.expr(f"terms * ({_value('p', 'q0')})")).alias("forth"),
            F.sum(F.expr(f"terms * ({_value('q0', 'p')} - {_value('q0', 'p0')})")).alias("back"),
        )
    )
    entries = (
        terms.select("lang", "source", "term", "n")
        .join(own, ["lang", "source"])
        .groupBy("lang", "term", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.expr(_share("n", "total")).alias("p"), "p0"))).alias("entries"))
    )
    # Terms with the same counts in the same sources are one cell.
    both = (
        entries.select("lang", "term", F.col("block").alias("a"), F.col("entries").alias("left"))
        .join(entries.select("lang", "term", F.col("block").alias("b"), F.col("entries").alias("right")), ["lang", "term"])
        .where("a <= b")
        .groupBy("lang", "a", "b", "left", "right")
        .agg(F.count("*").alias("terms"))
        .select("lang", "a", "b", "terms", "left", "right")
        .mapInArrow(_meet, MET)
        .groupBy("lang", "a", "b", "i", "j")
        .agg(F.sum("value").alias("value"))
    )
    named = lambda block, at, name: groups.select(
        "lang", F.col("block").alias(block), F.col("at").alias(at), F.col("source").alias(name)
    )
    common = both.join(named("a", "i", "source"), ["lang", "a", "i"]).join(named("b", "j", "item"), ["lang", "b", "j"])
    parts = (
        alone.select("lang", "source", "item", F.col("forth").alias("value"))
        .unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
        .unionByName(common.where("source <> item").select("lang", "source", "item", "value"))
    )
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        parts.groupBy("lang", "source", "item")
        .agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(down))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )


def divergence(
    documents: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = 3,
    top: int = 200,
) -> DataFrame:
    """How each source of a language differs from the others and from the language: lang, source, part, item, value, rank.

    Terms are runs of letters A to Z, made small, and of characters beyond
    ASCII. A language keeps the terms of at least `least_docs` of its
    documents. In a group, a term with n of the total occurrences has the share
    p = 1 + floor(10^9 (n + 1) / (total + kinds)), and p stands
    floor((p - q)^2 / q) from another share q of the term. Part `pair`: a row per other source of the language, q its
    share, the value summed over all kept terms. Part `term`: the `top` terms
    that the group has and uses more than the language does, q the language's.
    Ranks begin at 1 per group and part: largest value first, then the item's bytes.

    A null text, language or source is an empty one. Repeated rows count as
    often as they stand there, and every row is a document of its own. A language
    without kept terms has pairs of value 0 and no terms, one source has no
    pairs, an empty table gives an empty result. Other columns do not matter.
    """
    kept = stored(count_terms(documents, lang, source, text, least_docs), "divergence-terms")
    groups = stored(_groups(kept), "divergence-groups")
    rows = _pairs(kept, groups).unionByName(_top_terms(kept, groups, top))
    return rows.withColumn("rank", F.col("rank").cast("int"))
