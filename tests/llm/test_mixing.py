from fractions import Fraction

import pytest

from laneflow.llm import mixing


def brute_seats(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (Fraction(votes[j]) / (2 * given[j] + 1), -j))
        given[i] += 1
    return given


@pytest.mark.parametrize("votes,seats", [([53, 24, 23], 7), ([10, 10, 10], 4), ([1, 1000], 50), ([5], 9), ([0, 3], 4)])
def test_seats_go_by_highest_quotients(votes, seats):
    assert mixing.sainte_lague([Fraction(v) for v in votes], seats) == brute_seats(votes, seats)


def test_no_votes_no_seats():
    assert mixing.sainte_lague([Fraction(0)] * 3, 5) == [0, 0, 0]


def test_quotas_grow_with_the_house():
    votes = [Fraction(v) for v in (7, 13, 29, 101)]
    for seats in range(60):
        assert all(a <= b for a, b in zip(mixing.sainte_lague(votes, seats), mixing.sainte_lague(votes, seats + 1)))


def test_targets_stop_at_the_cap_and_the_rest_is_shared_again():
    assert mixing.targets([100, 10, 100], [1, 2, 3], 3) == [45, 30, 135]
    assert mixing.targets([0, 0], [1, 2], 3) == [0, 0]
    assert mixing.targets([], [], 3) == []


def test_each_source_comes_near_its_target(documents, words):
    w = words(1)
    rows = [(i, w.text(w.random.randint(0, 60)), None, ["b", "a", "a", "a", None, "ä"][i % 6]) for i in range(600)]
    rows += [(700, None, None, "a"), (701, "", None, "a"), (702, " \t\n ", None, "empty only"), (703, "z " * 9000, None, "a")]
    docs = documents(rows, extra=("size", "target", "_key", "_at"))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in found)
    by_source = {}
    for r in found:
        s = by_source.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert sum(s[2] for s in by_source.values()) == sum(size.values())
    for taken, target, _ in by_source.values():
        assert abs(taken - target) <= max(2, 0.01 * target)
    names = sorted(by_source, key=lambda n: (n is None, n or ""))
    wanted = mixing.targets([by_source[n][2] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3)
    assert [by_source[n][1] for n in names] == [float(t) for t in wanted]
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_shard_quotas_add_up(documents):
    block, given = mixing.shares({"a": 5000, "b": 200, None: 30}, (1, 2, 3), 3, 8, 100)
    assert all(len(g.blocks) == 8 and min(g.blocks) >= 0 for g in given)
    assert all(abs(sum(g.blocks) * block - g.target) <= block for g in given)


def test_mixed_corpus_has_the_words_taken(documents, words):
    w = words(2)
    rows = [(i, w.text(w.random.randint(1, 40)), "en", "abc"[i % 3]) for i in range(90)] + [(95, None, "en", "a")]
    docs = documents(rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got, texts = {}, dict((r[0], r[1]) for r in rows)
    for r in mixed.collect():
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in taken.items() if v}


def test_empty_table(documents):
    assert mixing.mix(documents([])).collect() == []


def test_mixed_corpus_row_by_row_with_null_and_repeated_ids(documents, words):
    w = words(3)
    rows = [(i, w.text(w.random.randint(1, 40)), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(None, f"null{i} " + w.text(20), "en", "abc"[i % 3]) for i in range(9)]  # no id
    rows += [(100, "same words in four rows", "en", "c")] * 4  # repeated rows
    rows += [(200, "long " + w.text(50), "en", "c"), (200, "short one", "en", "b"), (200, None, "en", "b")]  # one id, other texts
    docs = documents(rows)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    got, seen = {}, {}
    for r in mixing.apply_mix(docs).collect():
        whole = [t for i, t, _, s in rows if i == r["doc_id"] and s == r["source"] and t and t.startswith(r["text"])]
        assert whole and r["n_chars"] == len(r["text"])
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
        seen.setdefault((r["doc_id"], whole[0]), []).append(len(r["text"].split()))
    assert got == {k: v for k, v in taken.items() if v}
    for (i, text), pieces in seen.items():
        copies = sum((i, text) == (a, b) for a, b, _, _ in rows)
        assert sum(pieces) <= 3 * copies * len(text.split())
    assert any(i is None for i, _ in seen)
