import collections
import random

import numpy as np
import pytest

from laneflow.llm import neardup


def brute(rows, k, percent=80):
    """component of every id: all pairs that share a shingle are compared."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        n = min(k, len(w))
        sets.setdefault(doc_id, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    post = collections.defaultdict(list)
    for i, s in sets.items():
        for j, both in collections.Counter(j for x in s for j in post[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            post[x].append(i)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def changed(draw, text, share):
    words = text.split(" ")
    for i in range(len(words)):
        if draw.random() < share:
            words[i] = "w%d" % draw.randrange(10**6)
    return " ".join(words)


def corpus():
    """Prose, exact copies, near copies of every degree, a passage that many share, and edge cases."""
    draw = random.Random(11)
    fresh = lambda n: " ".join("v%d" % draw.randrange(10**5) for _ in range(n))
    rows = [(i, fresh(draw.randint(1, 120))) for i in range(120)]
    template = fresh(150)
    rows += [(1000 + i, changed(draw, template, draw.choice([0.005, 0.01, 0.02, 0.03, 0.05]))) for i in range(160)]
    rows += [(2000 + i, "The SAME text of ten words\nis here once more again") for i in range(120)]
    rows += [(2500, "the same  text of ten words is here once more again")]
    passage = fresh(60)
    rows += [(3000 + i, fresh(draw.randint(5, 60)) + " " + passage + " " + fresh(draw.randint(5, 60))) for i in range(60)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "one"), (4004, "One"), (4005, "one two three"),
             (4006, "ONE two three"), (4007, "É é"), (4008, "é É"), (4009, "a\xa0b"), (4010, "x y " * 30_000)]
    return rows


@pytest.mark.parametrize("k,cell", [(4, 128), (5, 24)])
def test_components_equal_brute_force(documents, monkeypatch, k, cell):
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)  # small cells take the rounds for large groups
    rows = corpus()
    docs = documents(rows + [rows[5]], extra=("digest", "node", "comp", "n_shingles"))
    found = neardup.near_duplicates(docs, words=k).collect()
    assert len(found) == len(rows) + 1
    comps, sizes = brute(rows, k)
    wrong = [(r["doc_id"], r["component_id"], comps[r["doc_id"]]) for r in found if r["component_id"] != comps[r["doc_id"]]]
    assert wrong == []
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = neardup.keep_one(docs, words=k)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in comps.items() if i == c}


def test_null_ids_and_empty_tables(documents):
    rows = neardup.near_duplicates(documents([(None, "a b c"), (None, "a b c"), (1, "a b c")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 0, True), (1, 1, True)]
    assert neardup.near_duplicates(documents([])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 - i, 5001 - i) for i in range(50)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {i: 4951 for i in range(4951, 5002)}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_merged_components(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    labels = frame([(4, 4), (5, 4), (6, 4), (9, 8), (20, 20), (21, 20)], ("node", "label"))
    assert neardup.merged(labels, frame([], "ab")) is labels
    assert neardup.merged(labels, frame([(4, 4)], "ab")) is labels
    found = neardup.merged(labels, frame([(4, 8), (3, 8), (4, 8), (30, 31)], "ab")).collect()
    assert sorted(tuple(r) for r in found) == [(3, 3), (4, 3), (5, 3), (6, 3), (8, 3), (9, 3), (20, 20), (21, 20), (30, 30), (31, 30)]


def test_large_groups_write_few_tables(documents, monkeypatch):
    """Each table written is a query more to plan and to keep track of in the driver: the passes for large groups go on
    from the components found so far instead of finding them all again."""
    written, stored = [], neardup.stored
    monkeypatch.setattr(neardup, "CELL_ROWS", 24)
    monkeypatch.setattr(neardup, "stored", lambda rows, purpose: written.append(purpose) or stored(rows, purpose))
    rows = corpus()
    found = neardup.near_duplicates(documents(rows)).collect()
    comps, _ = brute(rows, 5)
    assert {r["doc_id"]: r["component_id"] for r in found} == comps
    assert len(written) <= 45, (len(written), written)


def test_sketches_and_tuples_follow_similarity():
    draw = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        close = 0
        meets = 0
        for _ in range(60):
            pool = draw.integers(0, 2**63, size=600, dtype=np.uint64)
            both = int(300 * share)
            one, two = np.unique(pool[:300]), np.unique(np.concatenate((pool[:both], pool[300 : 600 - both])))
            truth = both / (600 - both)
            a, b = neardup.sketch(one), neardup.sketch(two)
            used = ((a != 0) | (b != 0)).sum()
            close += abs(((a == b) & (a != 0)).sum() / used - truth) < 0.1
            s, t = neardup.minhash_tuples(one), neardup.minhash_tuples(two)
            meets += bool((s[:10] == t[:10]).any() and (s[10:] == t[10:]).any())
        assert close >= 55
        assert meets >= 59 or share < 0.9


def test_rows_are_kept_one_by_one_with_null_and_repeated_ids(documents):
    draw = random.Random(4)
    t, u, v, z, n = (" ".join("x%d" % draw.randrange(10**6) for _ in range(40)) for _ in range(5))
    rows = [(3, t), (5, t), (5, u), (3, v), (7, z), (7, z), (None, t), (None, n), (None, n), (None, n + " more"), (8, None), (None, "")]
    kept = neardup.keep_one(documents(rows, extra=("node", "comp", "_row"))).collect()
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept)
    unlinked = [x for x in found if x[1] not in (n, n + " more")]
    assert unlinked == sorted([(3, t), (5, u), (3, v), (7, z), (8, ""), (0, "")])
    assert len(found) == len(unlinked) + 1


def test_sets_of_one_id_are_linked(documents):
    draw = random.Random(9)
    a, b, c, d, e = (" ".join("x%d" % draw.randrange(10**6) for _ in range(30)) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (21, d), (21, c), (30, e), (30, a + " end"), (2, e), (40, "alone here now or never")]
    found = neardup.near_duplicates(documents(rows), words=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {
        (3, 2), (5, 2), (9, 2), (20, 20), (21, 20), (30, 2), (2, 2), (40, 40)}
    assert {r["doc_id"] for r in found if r["kept"]} == {2, 20, 40}
