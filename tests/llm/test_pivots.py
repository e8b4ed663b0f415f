import math

import duckdb
import numpy as np
import pytest

from laneflow.llm import oracle, pivots

SCHEMA = "vec_id long, embedding array<double>, score int"


def brute(rows, k=20, every=20):
    """Exact integers all through; every row is its own query and candidate."""
    usable = []
    for i, (vec_id, vector, *_) in enumerate(rows):
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((i, vec_id, [math.floor(64 * x) for x in vector]))
    out = []
    for i, vec_id, q in usable:
        if vec_id is None or vec_id % every:
            continue
        found = []
        for j, other, v in usable:
            if j != i and len(v) == len(q):
                score = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v))))
                found.append((-score, other is None, other or 0))
        out += [(vec_id, rank, None if none else other, -score) for rank, (score, none, other) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(frame, **options):
    return sorted((tuple(r) for r in pivots.search(frame, **options).collect()), key=str)


def clustered(n, size=16, groups=12, spread=0.05, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, size))
    return [(i, (centres[i % groups] + spread * draw.normal(size=size)).tolist(), 1) for i in range(n)]


def odd():
    return [
        (1000, None, 1), (1020, [1.0] * 15 + [None], 1), (1040, [float("nan")] * 16, 1), (1060, [float("inf")] * 16, 1),
        (1080, [0.0] * 16, 1), (1100, [1e-200] * 16, 1), (1120, [-1e-200] * 16, 1), (1140, [1.0, 2.0], 1), (1141, [3.0, -1.0], 1),
        (1160, [], 1), (1161, [], 1), (None, [1.0] * 16, 1), (1180, [5.0], 1), (-20, [0.3] * 16, 1), (1201, [1e20] * 16, 1),
        (1220, [-1e25] + [2.0] * 15, 1), (1222, [3e7] * 16, 1),
    ]


@pytest.mark.parametrize("cell_rows,block_rows", [(16_384, (4096, 65_536)), (20, (10, 10))])
def test_equals_brute_force_whatever_the_cells(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(pivots, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(pivots, "SET_VISITS", 5 if cell_rows == 20 else 16_384)
    rows = clustered(300) + odd()
    rows += [(2000 + i, rows[40][1], 1) for i in range(170)]  # a third of all rows is one vector
    rows += [rows[20], rows[20], (20, rows[33][1], 1)]  # repeated rows, and an id on two vectors
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumnRenamed("score", "rank")
    assert found(frame) == brute(rows)


def test_even_vectors_and_few_results(spark):
    draw = np.random.default_rng(3)
    rows = [(i, v, 0) for i, v in enumerate(draw.normal(size=(200, 24)).tolist())]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, k=7, queries_every=13) == brute(rows, 7, 13)
    assert found(frame.limit(3)) == brute(rows[:3])
    assert found(frame.limit(1)) == [] and found(frame.limit(0)) == []


def test_lengths_without_pivots_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PIVOT_BYTES", (pivots.PIVOTS + 1) * 16 * 8)
    rows = clustered(120) + [(500 + i, v, 1) for i, (_, v, _) in enumerate(clustered(80, size=20, seed=2))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def blocks(vectors, cells):
    """The blocks, one per cell, as the tasks have them."""
    chosen = np.concatenate([np.zeros((1, vectors.shape[1])), pivots.choose_pivots(vectors, pivots.PIVOTS)])
    space = pivots.Space(chosen, float(np.square(vectors).sum(axis=1).max()), cells, None, None)
    far = pivots._to_pivots(vectors, space)
    cell = far[:, 1 : cells + 1].argmin(axis=1)
    low = np.array([far[cell == c].min(axis=0) if (cell == c).any() else np.full(far.shape[1], np.inf) for c in range(cells)])
    high = np.array([far[cell == c].max(axis=0) if (cell == c).any() else np.full(far.shape[1], -np.inf) for c in range(cells)])
    space = space._replace(low=low, high=high)
    ids = np.arange(len(vectors))
    return space, [
        pivots.Block(ids[cell == c], ids[cell == c], np.ones((cell == c).sum(), bool), vectors[cell == c], far[cell == c], space)
        for c in range(cells) if (cell == c).any()
    ]


def test_pivots_leave_most_of_clustered_rows_unseen():
    vectors = np.floor(64 * np.array([v for _, v, _ in clustered(6000, size=32, groups=60, spread=0.02)]))
    space, (block,) = blocks(vectors, 1)
    for row in range(0, 6000, 300):
        at, scores = block.best(row, vectors[row], 20, -np.inf, False)
        truth = vectors @ vectors[row]
        truth[row] = -np.inf
        assert scores.tolist() == np.sort(truth)[::-1][:20].astype(int).tolist()
    assert block.looked < 0.15 * 20 * 6000


def test_bounds_hold(spark):
    draw = np.random.default_rng(1)
    vectors = np.floor(64 * draw.normal(size=(500, 8)) * draw.choice([0.01, 1.0, 30.0], size=(500, 1)))
    space, made = blocks(vectors, 8)
    far = pivots._to_pivots(vectors, space)
    truth = vectors @ vectors.T
    for i in range(500):
        most = pivots._most(np.abs(far - far[i]).max(axis=1), far[i, 0] ** 2, far[:, 0] ** 2, space.norm2)
        assert (most >= truth[i]).all()
    cells = far[:, 1:9].argmin(axis=1)
    most = pivots._cells_most(vectors, space)
    for c in set(cells.tolist()):
        assert (most[:, c] >= truth[:, cells == c].max(axis=1)).all()


def test_sql_of_the_same(spark, tmp_path):
    rows = clustered(150) + [r for r in odd() if r[1] is None or all(x is None or abs(x) < 1e6 or not math.isfinite(x) for x in r[1])]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(str(tmp_path / "e"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    assert sorted(connection.execute(oracle.INNER_PRODUCTS).fetchall(), key=str) == found(frame)
