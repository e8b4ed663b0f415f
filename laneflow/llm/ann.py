"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are rotated so that their signs keep as much of them as possible
(iterative quantisation, learned on a bounded sample). The signs are a code of
64-bit words, split into substrings, each with an index of its own. If two
codes differ in at most r bits, then in one of the m substrings they differ in
at most r / m: probing every index for substrings that near finds every code
within the radius. What is found is ranked by exact cosines. A query that finds
too few, counted over all rows, is asked again with a wider radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneflow.llm.arrow import matrix, runs
from laneflow.llm.base import hash_sample, ship_code, stored

SUBSTRING = 16
LENGTHS = 16
ROTATION_BYTES = 64 << 20


class Codes(NamedTuple):
    """One rotation per 64-bit word or part of it, and the radius that reaches the wanted recall."""

    rotations: np.ndarray
    radius: int


def unit(vectors: np.ndarray) -> np.ndarray:
    even = evened(vectors)
    return even / np.linalg.norm(even, axis=1, keepdims=True)


def evened(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: squares neither vanish nor overflow.

    That changes no digit of a cosine.
    """
    if not vectors.shape[1]:
        return vectors
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """The rotation that brings unit vectors nearest to their own signs (iterative quantisation)."""
    size = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    for _ in range(rounds):
        signs = np.where(sample @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(sample.T @ signs)
        turn = left @ right
    return turn


def encode(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings: the signs under every rotation, padded with zeros."""
    bits = np.concatenate([unit(vectors) @ turn >= 0 for turn in rotations], axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING)))
    return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int32)


ALL_MASKS = np.arange(1 << SUBSTRING, dtype=np.uint32).astype(np.uint16)
# By radius: every 16-bit mask of at most that many ones.
MASKS = [ALL_MASKS[np.bitwise_count(ALL_MASKS) <= radius] for radius in range(SUBSTRING + 1)]


class Block:
    """The substring indexes of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, rows: np.ndarray | None = None):
        rows = np.arange(len(ids)) if rows is None else rows
        order = np.lexsort((rows, ids))  # that of ties
        self.ids, self.rows, self.vectors = ids[order], rows[order], evened(vectors[order])
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.codes = encode(self.vectors, codes.rotations)
        self.radius = codes.radius
        self.compared = 0
        self.tables = []
        for i in range(self.codes.shape[1]):
            members = np.argsort(self.codes[:, i], kind="stable")
            values, starts, counts = np.unique(self.codes[members, i], return_index=True, return_counts=True)
            self.tables.append((members, values, starts, counts))

    def within_radius(self, code: np.ndarray, more: int = 0) -> np.ndarray:
        """Rows whose code differs in at most the radius: the first `radius % m + 1` substrings are probed up to
        radius // m bits, the others up to one less, which by the pigeonhole principle misses none."""
        m, radius = len(self.tables), self.radius + more
        each, rest = divmod(radius, m)
        hit = np.zeros(len(self.ids), dtype=bool)
        for i, (members, values, starts, counts) in enumerate(self.tables):
            near = each if i <= rest else each - 1
            if near < 0:
                continue
            # The substrings in use are fewer than the masks once the radius is wide: hold them against the query's.
            if len(values) <= len(MASKS[min(near, SUBSTRING)]):
                buckets = np.flatnonzero(np.bitwise_count(values ^ code[i]) <= near)
            else:
                probes = MASKS[min(near, SUBSTRING)] ^ code[i]
                at = np.searchsorted(values, probes)
                at[at == len(values)] = 0
                buckets = at[values[at] == probes]
            sizes = counts[buckets]
            if sizes.sum():
                ends = np.cumsum(sizes)
                spots = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[buckets], sizes)
                hit[members[spots]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], code) <= radius]

    def cosines(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Row by row in one order of additions, so equal vectors have equal scores."""
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.linalg.norm(query))

    def nearest(self, row: int, query: np.ndarray, code: np.ndarray, k: int, more: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best rows within the radius and `more`, without the query's own, their scores, and how many there were."""
        at = self.within_radius(code, more)
        at = at[self.rows[at] != row]
        self.compared += len(at)
        scores = self.cosines(at, query)
        best = np.lexsort((at, -scores))[:k]
        return at[best], scores[best], len(at)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors with an id, without null, NaN or infinite components, and not zero."""
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def frame_matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def learn(
    rows: DataFrame, total: int, size: int, recall: float = 0.98, sample: int = 4096, probes: int = 64, words: int = 2,
    k: int = 5,
) -> Codes:
    """Rotations from `sample` vectors, and the radius within which `probes` of them find `recall` of their true
    nearest neighbours among all rows, measured by brute force in one pass over the blocks."""
    drawn = hash_sample(rows, total, sample, "row").toPandas()
    if not len(drawn):  # a hash may draw none of a few
        drawn = rows.limit(probes).toPandas()
    vectors = frame_matrix(drawn["v"])
    rotations = np.array([learn_rotation(unit(vectors), seed) for seed in range(_turns(size, words))])
    asked = drawn.head(probes)
    queries, own = frame_matrix(asked["v"]), asked["row"].to_numpy()
    codes = encode(queries, rotations)
    bits = rotations.shape[0] * size

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v, ids = matrix(batch.column("v"), slice(0, len(batch))), batch.column("row").to_numpy()
            scores = unit(queries) @ unit(v).T
            scores[own[:, None] == ids[None, :]] = -2
            seen = encode(v, rotations)
            for i in range(len(own)):
                best = np.argpartition(-scores[i], min(k, len(ids) - 1))[:k]
                best = best[scores[i][best] > -2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), i, np.int32)), pa.array(scores[i][best]), pa.array(distances(seen[best], codes[i]))],
                    names=["query_id", "score", "bits"],
                )

    near = rows.select("row", "v").mapInArrow(truth, "query_id int, score double, bits int")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k)
    found = np.sort(best.select("bits").toPandas()["bits"].to_numpy())
    radius = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) if len(found) else bits
    return Codes(rotations, min(radius, bits))


def _turns(size: int, words: int = 2) -> int:
    return -(-64 * words // max(size, 1))


def whole(size: int) -> Codes:
    """Codes of a length that no rotations were learned for: every row is within the radius."""
    turns = _turns(min(size, 128))
    return Codes(np.broadcast_to(np.eye(max(size, 1), min(size, 128)), (turns, max(size, 1), min(size, 128))), turns * min(size, 128))


def _learned(rows: DataFrame, counts: DataFrame, recall: float, k: int) -> dict[int, Codes]:
    """Codes of the most frequent lengths, as many as may be broadcast."""
    codes, room = {}, ROTATION_BYTES
    for r in counts.orderBy(F.desc("n"), "size").limit(LENGTHS).collect():
        room -= _turns(r["size"]) * r["size"] ** 2 * 8
        if room < 0:
            break
        codes[r["size"]] = learn(rows.where(F.col("size") == r["size"]), r["n"], r["size"], recall, k=k)
    return codes


FOUND = "query_row long, row long, vec_id long, score double, hits long"
FOUND_ARROW = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())])


def _probe(rows: DataFrame, counts: DataFrame, asked: DataFrame, shared, more: int, k: int, each: int, query_block: int) -> DataFrame:
    """What queries find within their radius and `more`: of each block the k best, and the first with the number of hits.

    A task holds one block, builds its index once and reads queries past it as a stream.
    """
    sets = asked.groupBy("size").agg(F.ceil(F.count("*") / query_block).cast("int").alias("sets"))
    plan = counts.join(sets, "size").select(F.col("size").alias("_size"), F.ceil(F.col("n") / each).cast("int").alias("blocks"), "sets")
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "row"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - F.lit(1)))
    same = F.col("size") == F.col("_size")
    index = rows.join(plan, same).select(
        "size", dealt("block", F.col("blocks")).alias("block"), upto(F.col("sets")).alias("set"), F.lit(0).alias("part"), "row", "vec_id", "v"
    )
    query = asked.join(plan, same).select(
        "size", upto(F.col("blocks")).alias("block"), dealt("set", F.col("sets")).alias("set"), F.lit(1).alias("part"), "row", "vec_id", "v"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, held, block, codes = shared.value, None, [], None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("size", "block", "set", "part")]
            numbers, ids, out = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), []
            for run in runs(*columns):
                here = tuple(int(c[run.start]) for c in columns[:3])
                if here != key:
                    key, held, block = here, [], None
                    codes = known.get(here[0]) or whole(here[0])
                if columns[3][run.start] == 0:
                    held.append((ids[run], matrix(batch.column("v"), run), numbers[run]))
                    continue
                if block is None and held:
                    own, vectors, places = (np.concatenate(p) for p in zip(*held))
                    block, held = Block(own, vectors, codes, places), []
                if block is None:
                    continue
                vectors = evened(matrix(batch.column("v"), run))
                for row, vector, code in zip(numbers[run], vectors, encode(vectors, codes.rotations)):
                    at, scores, hits = block.nearest(int(row), vector, code, k, more)
                    first = np.zeros(len(at), dtype=np.int64)
                    first[:1] = hits
                    out.append((np.full(len(at), row), block.rows[at], block.ids[at], scores, first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=FOUND_ARROW)

    place = ["size", "block", "set"]
    return index.unionByName(query).repartition(*place).sortWithinPartitions(*place, "part").mapInArrow(meet, FOUND)


def search(
    vectors: DataFrame,
    queries_every: int = 50,
    k: int = 5,
    index_block: tuple[int, int] = (8192, 131_072),
    query_block: int = 8192,
    recall: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows found for every row whose id is a multiple of `queries_every`.

    Columns query_id, rank (from 1), vec_id, score (cosine in double precision
    of the original vectors), nearest first, ties to the smaller id. The query
    itself is no candidate; with fewer than k other rows of its length, all are given.

    All rows are indexed, dealt by a hash into blocks: 64 of them, or as
    many as keep their rows within the two bounds of `index_block`. A task
    builds the indexes of its block once and reads up to about `query_block`
    queries past them. Copies of one vector are spread over the blocks, and a
    task holds one block whatever the data. Hits are counted over all blocks: only queries with
    fewer than k are asked again, with a radius wider by 2, 6, 14 and so on, until it takes in every code.

    Vectors that are null, zero or have null or non-finite components take no
    part, nor do rows without an id; ids are read as BIGINT. Rows of one id and different vectors are
    each a query and a candidate, repeated rows are one. Vectors are compared with
    those of their length, each length with codes of its own; lengths whose
    rotations do not fit into the broadcast (the 16 most frequent lengths within 64 MB do) are compared with
    every row of theirs. Other columns do not matter; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    plain = valid(vectors, id_col, vector_col).select("vec_id", F.col("vector").alias("v")).distinct()
    rows = stored(plain.select("vec_id", F.size("v").alias("size"), "v", F.monotonically_increasing_id().alias("row")), "ann")
    counts = stored(rows.groupBy("size").agg(F.count("*").alias("n")), "ann-lengths")
    codes = _learned(rows, counts, recall, k)
    shared = spark.sparkContext.broadcast(codes)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = min(index_block[1], max(index_block[0], total // 64))
    bits = max([c.rotations.shape[0] * s for s, c in codes.items()], default=0)

    asked = rows.where(F.pmod("vec_id", F.lit(queries_every)) == 0)
    ids = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    needed = counts.select("size", F.least(F.lit(k), F.col("n") - 1).alias("need"))
    rounds, more, widening = [], 0, 2
    while True:
        found = stored(_probe(rows, counts, asked, shared, more, k, each, query_block), "ann-found")
        hits = found.groupBy(F.col("query_row").alias("row")).agg(F.sum("hits").alias("hits"))
        short = asked.join(hits, "row", "left").join(needed, "size").where(F.coalesce("hits", F.lit(0)) < F.col("need"))
        short = stored(short.select(*rows.columns), "ann-short")
        few = more < bits and not short.isEmpty()
        rounds.append(found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti") if few else found)
        if not few:
            break
        asked, more, widening = short, more + widening, widening * 2

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = reduce(DataFrame.unionByName, rounds).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")
