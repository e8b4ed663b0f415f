import numpy as np
import pytest

from laneflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(x, axis=1)
    best = {}
    for i in np.flatnonzero(ids % 50 == 0):
        scores = (x * x[i]).sum(axis=1) / (norms * norms[i])
        scores[i] = -9
        order = np.lexsort((ids, -scores))[: min(k, len(rows) - 1)]
        best[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return best


def vectors(n, size=32, groups=40, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, size))
    x = (centres[draw.integers(0, groups, n)] + 0.4 * draw.normal(size=(n, size))).astype(np.float32)
    return [(i, v.tolist(), i % 3) for i, v in enumerate(x)]


def test_recall_and_scores(spark):
    rows = vectors(3000)
    rows += [(3000 + i, rows[50][1], 0) for i in range(1500)]  # a third of all rows is one vector
    bad = [(9000, None, 0), (9050, [0.0] * 32, 0), (9100, [float("nan")] * 32, 0), (9150, [1.0, None] * 16, 0),
           (9200, [float("inf")] * 32, 0), (9250, [1.0, 2.0], 0), (9300, [], 0), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows + bad + [rows[7]], SCHEMA).repartition(4).withColumnRenamed("label", "score")
    found = ann.search(frame, index_block=(1000, 1000), query_block=40).collect()
    truth, got = brute(rows), {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(truth)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(near, near[1:]))
        hits += len({n[1] for n in near} & {t[0] for t in truth[q]})
    assert hits >= 0.9 * 5 * len(truth)
    assert [n[1] for n in got[50]] == [3000, 3001, 3002, 3003, 3004]  # ties go to the smaller id


def test_few_rows_and_none(spark):
    rows = vectors(3)
    found = ann.search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, i) for i, _ in brute(rows)[0]]
    assert ann.search(spark.createDataFrame(rows[:1], SCHEMA)).collect() == []
    assert ann.search(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 13, 30, 64])
def test_probing_finds_exactly_the_codes_within_the_radius(radius):
    draw = np.random.default_rng(radius)
    x = draw.normal(size=(700, 32))
    turns = np.array([ann.learn_rotation(ann.unit(x), seed, rounds=3) for seed in range(2)])
    block = ann.Block(np.arange(700), x, ann.Codes(turns, radius))
    for i in range(0, 700, 70):
        near = np.flatnonzero(ann.distances(block.codes, block.codes[i]) <= radius)
        assert set(block.within_radius(block.codes[i])) == set(near)


def test_rotations_are_rotations():
    x = ann.unit(np.random.default_rng(1).normal(size=(500, 16)))
    turn = ann.learn_rotation(x, 0)
    assert np.allclose(turn @ turn.T, np.eye(16))


def exact(rows, k=5, every=50):
    """Cosines of all rows of a query's length, in long doubles; rows of one id and vector count once."""
    seen = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(np.isfinite(v)) and any(v)})
    out = {}
    for n, (i, v) in enumerate(seen):
        if i % every:
            continue
        q = np.array(v, dtype=np.longdouble)
        found = []
        for m, (j, w) in enumerate(seen):
            if m != n and len(w) == len(v):
                x = np.array(w, dtype=np.longdouble)
                found.append((-float((q * x).sum() / np.sqrt((q * q).sum()) / np.sqrt((x * x).sum())), j))
        out.setdefault(i, []).append(sorted(found)[:k])
    return out


def test_lengths_repeated_ids_and_extreme_values(spark):
    double = "vec_id long, embedding array<double>, label int"
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.1], 0), (2, [1.0, 0.0, 0.0], 0), (50, [1.0, 1.0, 0.0], 0)]
    found = ann.search(spark.createDataFrame(rows, double)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 3)) for r in sorted(found, key=tuple)] == [
        (0, 1, 1, 0.995), (0, 2, 1, 0.0), (50, 1, 2, 0.707)]
    rows = [(0, [1e-200, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (50, [1e200, 1e200], 0), (3, [-1e300, 1e-300], 0), (4, [1e200], 0),
            (100, [-1e-300], 0), (5, [2.0], 0), (0, [1e-200, 0.0], 0)]
    found = ann.search(spark.createDataFrame(rows, double)).collect()
    got = {}
    for r in sorted(found, key=tuple):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for query, (near,) in exact(rows).items():
        assert [j for _, j in got[query]] == [j for _, j in near] and np.allclose([s for s, _ in got[query]], [s for s, _ in near])


def test_queries_short_of_hits_are_asked_again(spark, monkeypatch):
    learn = ann.learn
    monkeypatch.setattr(ann, "learn", lambda *a, **o: learn(*a, **o)._replace(radius=0))
    rows = vectors(400, groups=20, seed=3)
    found = ann.search(spark.createDataFrame(rows, SCHEMA)).collect()
    truth = brute(rows)
    assert {q: len([r for r in found if r["query_id"] == q]) for q in truth} == dict.fromkeys(truth, 5)


def test_clustered_vectors_are_mostly_left_alone(spark):
    """4000 clusters in 64 dimensions: the share of pairs that cosines are worked out for, over 8 blocks."""
    rows = vectors(16_000, size=64, groups=1000, seed=5)
    x = np.array([r[1] for r in rows], dtype=np.float64)
    frame = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "row long, vec_id long, v array<double>")
    codes = ann.learn(frame, len(rows), 64)
    compared = asked = hits = 0
    best = [[] for _ in range(0, 16_000, 400)]
    for b in range(8):
        ids = np.arange(b, 16_000, 8)
        block = ann.Block(ids, x[ids], codes)
        block.rows = block.ids
        for n, q in enumerate(range(0, 16_000, 400)):
            at, scores, _ = block.nearest(q, ann.evened(x[q : q + 1])[0], ann.encode(x[q : q + 1], codes.rotations)[0], 5)
            best[n] += list(zip(-scores, block.ids[at]))
        compared, asked = compared + block.compared, asked + 40 * len(ids)
    for n, q in enumerate(range(0, 16_000, 400)):
        scores = ann.unit(x) @ ann.unit(x[q : q + 1])[0]
        scores[q] = -2
        hits += len({int(i) for _, i in sorted(best[n])[:5]} & set(np.argsort(-scores)[:5].tolist()))
    assert compared < 0.05 * asked and hits >= 0.95 * 200
