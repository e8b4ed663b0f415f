"""Mix sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Every source gets a target in words. A house of equal blocks is shared out by
the highest quotients target / (2k + 1), once per output shard for the blocks
up to that shard, so the quotas of each shard are whole numbers and add up.
The documents of a source stand in a seeded order; its blocks are runs of equal
length in that order, and a source takes its first blocks, going round again
when its quota is larger than the source.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.llm.base import fresh, running_start, stored, word_count


class Share(NamedTuple):
    """What the mix takes of one source; `blocks` has its quota in each shard."""

    source: str | None
    size: int
    target: float
    blocks: list[int]
    words: int


def targets(sizes: list[int], weights: list[int], cap: int) -> list[Fraction]:
    """Shares of the sum of all sizes by weight; none above `cap` times its size, what is over going to the others."""
    left, result = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in over or open_:
            result[i] = Fraction(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(result[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return result


def sainte_lague(votes: list[Fraction], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2k + 1); equal quotients go to the earlier party.

    A divisor gives all but at most as many seats as there are parties at once;
    a heap gives the rest, so the work does not grow with the seats.
    """
    total, parties = sum(votes), len(votes)
    if not total:
        return [0] * parties
    given = [0] * parties
    if 2 * seats > parties:
        divisor = 2 * total / (2 * seats - parties)
        given = [int(v / divisor + Fraction(1, 2)) for v in votes]
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, given)) if v]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def shares(
    sizes: dict[str | None, int], weights: tuple[int, ...], cap: int, shards: int, fineness: int
) -> tuple[int, list[Share]]:
    """The block length in words and what each source gives.

    A block is at most 1 / `fineness` of the smallest target above zero, so no
    source is off its target by more than that share of it.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = targets([sizes[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], cap)
    least = min((t for t in wanted if t), default=Fraction(0))
    block = max(1, int(least / fineness))
    house = round(sum(wanted) / block)
    upto = [sainte_lague(wanted, house * (s + 1) // shards) for s in range(shards)]
    result = []
    for i, name in enumerate(names):
        quotas = [upto[s][i] - (upto[s - 1][i] if s else 0) for s in range(shards)]
        words = min(upto[-1][i] * block, cap * sizes[name])
        result.append(Share(name, sizes[name], float(wanted[i]), quotas, words))
    return block, result


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    shards: int = 8,
    fineness: int = 1000,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: how many of its words the mix takes.

    Columns doc_id, source, size (words), source_size, target, taken, rounds
    (how often the whole document is taken), head (words taken once more from
    its start; only one document per source has a head shorter than itself),
    shard (of its first word, null if nothing is taken).

    Sources stand by code point, null last, and weigh `weights`, repeating.
    Null and empty texts have size 0 and give nothing. Rows with equal id, text
    and source are interchangeable. An empty table gives an empty result, a
    source without words a target of 0. The seeded order depends on id, text
    and seed alone, so reruns agree. Other columns of `docs` are ignored.

    One row per source reaches the driver; documents and blocks do not.
    """
    return _mix_rows(docs, F.lit(None).cast("long"), weights, cap, shards, fineness, seed, id_col, text_col, source_col).drop("_row")


def _mix_rows(
    docs: DataFrame,
    row: Column,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    shards: int = 8,
    fineness: int = 1000,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The result of `mix` with `_row`, the value of `row`: it tells rows of equal id, text and source apart."""
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            row.alias("_row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col)).alias("_key"),
        ),
        "mix",
    )
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    block, given = shares(sizes, weights, cap, shards, fineness)
    schema = "_s string, source_size long, target double, _words long, _upto array<long>"
    plan = spark.createDataFrame(
        [
            (g.source, g.size, g.target, g.words, [sum(g.blocks[: s + 1]) for s in range(shards)])
            for g in given
        ],
        schema,
    )
    placed = running_start(rows, ["source"], "_key", "size", "_at", ties=("doc_id", "size", "_row"))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    whole = F.expr("IF(source_size > 0, _words div source_size, 0)")
    rest = F.col("_words") - F.col("rounds") * F.col("source_size")
    first = F.expr(f"_at div {block}")
    return (
        joined.withColumn("rounds", whole.cast("long"))
        .withColumn("head", F.greatest(F.lit(0), F.least(rest - F.col("_at"), F.col("size"))).cast("long"))
        .withColumn("taken", F.col("rounds") * F.col("size") + F.col("head"))
        .withColumn("shard", F.when(F.col("taken") > 0, F.size(F.filter("_upto", lambda u: u <= first))))
        .select("_row", "doc_id", "source", "size", "source_size", "target", "taken", "rounds", "head", "shard")
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, in the columns of `docs`: each document as often as taken, a head cut after its last word.

    Documents of which nothing is taken leave. `n_chars`, where it is a column,
    follows the text. Every row has its own rounds and head, whatever its id:
    rows are written once with a key of their own, and the mix is joined by it.
    """
    text_col = options.get("text_col", "text")
    row = fresh(docs, "_mix_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    key, rounds, head, size, words, text = (
        fresh(docs, f"_mix_{n}") for n in ("key", "rounds", "head", "size", "words", "text")
    )
    taken = _mix_rows(rows, F.col(row), **options).where("taken > 0").select(
        F.col("_row").alias(key), F.col("rounds").alias(rounds), F.col("head").alias(head), F.col("size").alias(size)
    )
    parts = F.concat(
        F.array_repeat(F.col(size), F.col(rounds).cast("int")),
        F.when(F.col(head) > 0, F.array(head)).otherwise(F.array().cast("array<bigint>")),
    )
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int")), "")
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns[text_col] = F.col(text)
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return (
        rows.join(taken, F.col(row) == F.col(key))
        .withColumn(words, F.explode(parts))
        .withColumn(text, F.when(F.col(words) < F.col(size), cut).otherwise(F.col(text_col)))
        .select(*[c.alias(n) for n, c in columns.items()])
    )
