"""Exact search for the largest inner products by pivot-table elimination.

Vectors are turned into integers. The inner product of two is half of what
their squared lengths exceed the square of their distance by. Distances to pivots, the origin
among them, are worked out once and kept with the rows. By the triangle
inequality the difference of two vectors' distances to a pivot bounds their
own distance from below; the largest of these bounds is held against the k-th
best score so far. Whole cells of rows are ruled out first, by the ranges of
their distances; in the others, candidates are taken in the order of their
bounds until no bound reaches the k-th score. Nothing else is left out, so
results are exact however little is ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneflow.llm.arrow import matrix, runs
from laneflow.llm.base import hash_sample, ship_code, stored

__all__ = ["search"]

PIVOTS = 64  # of a vector length
CELLS = 32  # at most as many as pivots
CELL_ROWS = 16_384
PIVOT_BYTES = 32 << 20  # what is broadcast of pivots, over all lengths
SAMPLE = 1024
BLOCK_ROWS = (4096, 65_536)
SET_VISITS = 16_384  # queries that one task puts to its block
CHUNK = 256  # candidates looked at between two looks at the stop
# Squared lengths below this leave all sums of products exact in a double.
WIDE = float(1 << 52)
NO_CELL = -1  # of rows without bounds: too long, or of a vector length without pivots
LONG = 2**63 - 1


class Space(NamedTuple):
    """Pivots of one vector length, the origin first, and the cells' ranges of distances to them."""

    pivots: np.ndarray
    norm2: float  # the largest squared length
    cells: int
    low: np.ndarray  # (cell, pivot)
    high: np.ndarray


def _to_pivots(vectors: np.ndarray, space: Space) -> np.ndarray:
    """Distances of rows to all pivots; the first pivot is the origin, so the first distance is the length."""
    norms, own = (np.einsum("ij,ij->i", x, x) for x in (vectors, space.pivots))
    return np.sqrt(np.maximum(norms[:, None] + own - 2 * vectors @ space.pivots.T, 0.0))


def _most(gap: np.ndarray, norm: np.ndarray | float, norms: np.ndarray | float, norm2: float) -> np.ndarray:
    """The largest inner product of vectors of these squared lengths at a distance of `gap` or more, and some more
    than rounding can take away."""
    slack = 4e-6 * np.sqrt(norm2)
    return (norm + norms - np.square(np.maximum(gap - slack, 0.0))) / 2 + 2e-6 * norm2 + 1e-3


def _cells_most(queries: np.ndarray, space: Space) -> np.ndarray:
    """(query, cell): the largest score that a row of the cell can have; below all scores for a cell without rows."""
    near = _to_pivots(queries, space)
    out = np.empty((len(queries), space.cells))
    for cell in range(space.cells):
        gap = np.maximum(near - space.high[cell], space.low[cell] - near).max(axis=1)
        out[:, cell] = _most(gap, np.square(near[:, 0]), np.square(space.high[cell, 0]), space.norm2)
    out[:, ~np.isfinite(space.low[:, 0])] = -np.inf
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each the farthest from those before it."""
    norms = np.einsum("ij,ij->i", sample, sample)
    chosen, gap = [int(np.argmax(norms))], np.full(len(sample), np.inf)
    while len(chosen) < count:
        last = sample[chosen[-1]]
        gap = np.minimum(gap, norms + last @ last - 2 * sample @ last)
        if gap.max() <= 0:
            break
        chosen.append(int(np.argmax(gap)))
    return sample[chosen]


class Block:
    """Rows of one cell with their distances to the pivots."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, far: np.ndarray | None, space: Space | None):
        # In the order of ties, so that a stable sort by score is the order of results.
        order = np.lexsort((rows, ids, ~known))
        self.rows, self.ids, self.known, self.vectors = rows[order], ids[order], known[order], vectors[order]
        # Single precision is within the slack of the bounds.
        self.far = np.ascontiguousarray(far[order].T, dtype=np.float32) if far is not None and space is not None else None
        self.room = None if self.far is None else np.empty_like(self.far)
        self.space = space
        self.short = space is not None or bool((np.einsum("ij,ij->i", vectors, vectors) < WIDE).all())
        self.by_row = np.argsort(self.rows)
        self.looked = 0

    def _scores(self, at: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        self.looked += len(at)
        if exact:
            return (self.vectors[at] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        sums = [sum(int(x) * y for x, y in zip(v, whole)) for v in self.vectors[at]]
        return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], dtype=np.int64)

    def best(self, row: int, query: np.ndarray, k: int, least: float, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best that reach `least`, without the query's own row."""
        own = self.by_row[np.searchsorted(self.rows, row, sorter=self.by_row) % len(self.rows)]
        others = np.ones(len(self.rows), dtype=bool)
        others[own] = self.rows[own] != row
        if self.far is None or wide:
            at = np.flatnonzero(others)
            return self._cut(at, self._scores(at, query, self.short and not wide), k, least)
        near = _to_pivots(query[None, :], self.space)[0]
        np.subtract(self.far, near.astype(np.float32)[:, None], out=self.room)
        gap = np.abs(self.room, out=self.room).max(axis=0).astype(np.float64)
        most = _most(gap, near[0] ** 2, np.square(self.far[0], dtype=np.float64), self.space.norm2)
        most[~others] = -np.inf
        # The best by bound first: their k-th score rules out most of the others, if anything does.
        at = np.argpartition(-most, CHUNK)[:CHUNK] if len(most) > CHUNK else np.arange(len(most))
        seen = at = at[most[at] >= max(least, -LONG - 1)]
        at, scores = self._cut(at, self._scores(at, query, True), k, least)
        if len(most) <= CHUNK:
            return at, scores
        bar = scores[-1] if len(at) == k else least
        left = most >= max(bar, -LONG - 1)
        left[seen] = False
        if np.count_nonzero(left) > len(most) // 4:
            # Bounds say little about this query: the rest at once is faster than in order.
            self.looked += len(most)
            left = np.flatnonzero(left)
            return self._cut(np.concatenate([at, left]), np.concatenate([scores, (self.vectors @ query).astype(np.int64)[left]]), k, least)
        left = np.flatnonzero(left)
        left = left[np.argsort(-most[left], kind="stable")]
        while len(left):
            head, left = left[:CHUNK], left[CHUNK:]
            at, scores = np.concatenate([at, head]), np.concatenate([scores, self._scores(head, query, True)])
            at, scores = self._cut(at, scores, k, least)
            if len(at) == k:
                left = left[most[left] >= scores[-1]]
        return at, scores

    @staticmethod
    def _cut(at: np.ndarray, scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > 4 * k:
            least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
        keep = scores >= least
        at, scores = at[keep], scores[keep]
        # -scores would overflow for the smallest long.
        order = np.lexsort((at, ~scores))[:k]
        return at[order], scores[order]


def _whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """row, vec_id, size, wide and v, the integers floor(scale * x), of the vectors that take part."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    floored = lambda c: F.when(F.abs(c) >= float(1 << 53), c).otherwise(F.floor(c).cast("double"))
    usable = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & usable)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    return (
        rows.select("vec_id", F.size("x").alias("size"), F.transform("x", floored).alias("v"))
        .withColumn("norm2", norm2)
        .withColumn("row", F.monotonically_increasing_id())
    )


def _learn(rows: DataFrame) -> dict[int, Space]:
    """Pivots of the most frequent vector lengths, as many as the broadcast allows; cells have no ranges yet."""
    lengths = (
        rows.where((F.col("norm2") < WIDE) & (F.col("size") > 0))
        .groupBy("size")
        .agg(F.count("*").alias("n"), F.max("norm2").alias("norm2"))
        .orderBy(F.desc("n"), "size")
        .limit(16)
        .collect()
    )
    spaces, room = {}, PIVOT_BYTES
    for r in lengths:
        room -= (PIVOTS + 1) * r["size"] * 8
        if room < 0:
            break
        usable = rows.where((F.col("size") == r["size"]) & (F.col("norm2") < WIDE))
        drawn = min(SAMPLE, max(PIVOTS, PIVOT_BYTES // (8 * r["size"])))
        sample = hash_sample(usable.select("row", "v"), r["n"], drawn, "row").toPandas()
        if not len(sample):  # a hash may draw none of a few
            sample = usable.select("v").limit(PIVOTS).toPandas()
        pivots = choose_pivots(np.array(sample["v"].tolist(), dtype=np.float64), PIVOTS)
        cells = max(1, min(CELLS, len(pivots), r["n"] // CELL_ROWS))
        pivots = np.concatenate([np.zeros((1, r["size"])), pivots])
        none = np.full((cells, len(pivots)), np.inf)
        spaces[r["size"]] = Space(pivots, float(r["norm2"]), cells, none, -none)
    return spaces


PLACED = "row long, vec_id long, size int, cell int, v array<double>, far array<double>"


def _placed(rows: DataFrame, spaces) -> DataFrame:
    """The pivot table: every row with its distances to the pivots and its cell, that of the nearest of the first pivots."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spaces.value
        for batch in batches:
            sizes, norm2 = batch.column("size").to_numpy(), batch.column("norm2").to_numpy()
            cell, far = np.full(len(sizes), NO_CELL, dtype=np.int32), [None] * len(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero((sizes == size) & (norm2 < WIDE))
                if size in known and len(at):
                    gaps = _to_pivots(matrix(batch.column("v"), at), known[size])
                    cell[at] = gaps[:, 1 : known[size].cells + 1].argmin(axis=1)
                    for i, g in zip(at, gaps):
                        far[i] = g
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("size"), pa.array(cell), batch.column("v"), pa.array(far, pa.list_(pa.float64()))],
                names=["row", "vec_id", "size", "cell", "v", "far"],
            )

    return rows.select("row", "vec_id", "size", "norm2", "v").mapInArrow(place, PLACED)


def _ranges(placed: DataFrame, spaces: dict[int, Space]) -> dict[int, Space]:
    """The spaces with the ranges of their cells: a row per cell and pivot reaches the driver."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cell = batch.column("size").to_numpy(), batch.column("cell").to_numpy()
            out = []
            for s, c in {*zip(size.tolist(), cell.tolist())}:
                far = matrix(batch.column("far"), np.flatnonzero((size == s) & (cell == c)))
                out += [(s, c, i, lo, hi) for i, (lo, hi) in enumerate(zip(far.min(axis=0).tolist(), far.max(axis=0).tolist()))]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("size", "cell", "pivot", "low", "high"), r)) for r in out],
                schema=pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]),
            )

    found = (
        placed.where(F.col("cell") != NO_CELL)
        .select("size", "cell", "far")
        .mapInArrow(parts, "size int, cell int, pivot int, low double, high double")
        .groupBy("size", "cell", "pivot")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    for r in found:
        space = spaces[r["size"]]
        space.low[r["cell"], r["pivot"]], space.high[r["cell"], r["pivot"]] = r["low"], r["high"]
    return spaces


VISITS = "row long, size int, cell int, v array<double>, least double, wide boolean"


def _visits(queries: DataFrame, spaces, first: bool) -> DataFrame:
    """The cells that queries visit: first the most promising, then all others that can still reach the k-th score.

    A query without bounds visits every cell at once.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spaces.value
        for batch in batches:
            sizes, own = batch.column("size").to_numpy(), batch.column("cell").to_numpy()
            least = batch.column("least").to_numpy()
            at, cells = [], []

            def go(rows, cell):
                at.extend(rows.tolist())
                cells.extend([cell] * len(rows))

            for size in np.unique(sizes):
                space = known.get(int(size))
                rows = np.flatnonzero((sizes == size) & (own != NO_CELL))
                if len(rows):
                    most = _cells_most(matrix(batch.column("v"), rows), space)
                    home = most.argmax(axis=1)
                    for cell in range(space.cells):
                        if first:
                            go(rows[home == cell], cell)
                        else:
                            go(rows[(home != cell) & (most[:, cell] >= least[rows])], cell)
                    if not first:
                        go(rows, NO_CELL)
                free = np.flatnonzero((sizes == size) & (own == NO_CELL))
                if first and len(free):
                    for cell in [NO_CELL, *range(space.cells if space else 0)]:
                        go(free, cell)
            chosen = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [chosen.column("row"), chosen.column("size"), pa.array(cells, pa.int32()), chosen.column("v"), chosen.column("least"),
                 pa.array(own[np.array(at, dtype=np.int64)] == NO_CELL)],
                names=["row", "size", "cell", "v", "least", "wide"],
            )

    return queries.select("row", "size", "cell", "v", "least").mapInArrow(visit, VISITS)


FOUND = "query_row long, row long, vec_id long, score long"
FOUND_ARROW = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _probe(placed: DataFrame, sizes: DataFrame, visits: DataFrame, spaces, k: int) -> DataFrame:
    """What the visits find. Each task holds one block of rows and reads queries past it as a stream."""
    visited = visits.groupBy("size", "cell").agg(F.greatest(F.ceil(F.count("*") / SET_VISITS), F.lit(1)).cast("int").alias("sets"))
    plan = sizes.join(visited, ["size", "cell"]).select(F.col("size").alias("_size"), F.col("cell").alias("_cell"), "blocks", "sets")
    same = (F.col("size") == F.col("_size")) & (F.col("cell") == F.col("_cell"))
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "row"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - F.lit(1)))
    no: Column = F.lit(None)
    index = placed.join(plan, same).select(
        "size", "cell", dealt("block", F.col("blocks")).alias("block"), upto(F.col("sets")).alias("set"),
        F.lit(0).alias("part"), "row", "vec_id", "v", "far", no.cast("double").alias("least"), F.lit(False).alias("wide"),
    )
    asked = visits.join(plan, same).select(
        "size", "cell", upto(F.col("blocks")).alias("block"), dealt("set", F.col("sets")).alias("set"),
        F.lit(1).alias("part"), "row", no.cast("long").alias("vec_id"), "v", no.cast("array<double>").alias("far"), "least", "wide",
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spaces.value
        key, held, block = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("size", "cell", "block", "set", "part")]
            rows, least, wide = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "least", "wide"))
            out = []
            for run in runs(*columns):
                here = tuple(int(c[run.start]) for c in columns[:4])
                if here != key:
                    key, held, block = here, [], None
                if columns[4][run.start] == 0:
                    ids = batch.column("vec_id").slice(run.start, run.stop - run.start)
                    far = None if here[1] == NO_CELL else matrix(batch.column("far"), run)
                    held.append((rows[run], ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), matrix(batch.column("v"), run), far))
                    continue
                if block is None and held:
                    whole = [None if part[0] is None else np.concatenate(part) for part in zip(*held)]
                    block, held = Block(*whole, None if here[1] == NO_CELL else known.get(here[0])), []
                if block is None:
                    continue
                for i, query in zip(range(run.start, run.stop), matrix(batch.column("v"), run)):
                    at, scores = block.best(int(rows[i]), query, k, least[i], bool(wide[i]))
                    out.append((np.full(len(at), rows[i]), block.rows[at], block.ids[at], ~block.known[at], scores))
            if out:
                q, r, ids, unknown, scores = (np.concatenate(part) for part in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(ids, pa.int64(), mask=unknown), pa.array(scores)], schema=FOUND_ARROW)

    place = ["size", "cell", "block", "set"]
    return index.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "part").mapInArrow(meet, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    down = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    queries_every: int = 20,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k rows of the largest integer inner product for every row whose id is a multiple of `queries_every`.

    Columns query_id, rank (from 1), vec_id, score, the largest first, ties to
    the smaller id. A component x counts as floor(scale * x). Every other row
    is a candidate, also one with the query's id; with fewer than k, all are given.

    Vectors that are null or hold null or non-finite components take no part;
    nor do those with a component that a double cannot hold scale times.
    Vectors are compared with those of their own length, the empty ones too
    (score 0). A row without an id is a candidate, after all ids, and no
    query. Of repeated rows each is a row of its own, as a query and as a candidate. A score beyond
    a BIGINT counts as its nearest bound. Other columns do not matter; an
    empty table gives an empty result.

    Rows are dealt into blocks of their cells, so that a hot cell, as of
    copies of one vector, is many tasks; a task holds one block and reads queries past it. Pivots, at most 32 MB
    of them, and the ranges of the cells are all that is broadcast; lengths beyond that are searched without bounds.
    """
    ship_code(vectors.sparkSession)
    context = vectors.sparkSession.sparkContext
    rows = stored(_whole(vectors, id_col, vector_col, scale), "pivots-rows")
    spaces = _learn(rows)
    placed = stored(_placed(rows, context.broadcast(spaces)), "pivots-table")
    shared = context.broadcast(_ranges(placed, spaces))
    counts = placed.groupBy("size", "cell").agg(F.count("*").alias("n"))
    total = placed.count()
    each = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], total // 64))
    sizes = stored(counts.select("size", "cell", F.ceil(F.col("n") / each).cast("int").alias("blocks")), "pivots-cells")
    asked = placed.where(F.pmod("vec_id", F.lit(queries_every)) == 0)

    # Every query at its most promising cell; the k-th score there is the least that the others have to reach.
    opened = stored(_visits(asked.withColumn("least", F.lit(float("-inf"))), shared, True), "pivots-first")
    near = stored(_ranked(_probe(placed, sizes, opened, shared, k), k), "pivots-near")
    kth = near.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("kth"))
    bounded = asked.join(kth, "row", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf"))))
    later = stored(_visits(bounded, shared, False), "pivots-later")
    rest = _probe(placed, sizes, later, shared, k)

    best = _ranked(near.drop("rank").unionByName(rest), k)
    ids = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
