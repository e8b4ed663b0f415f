import hashlib
import random
import zlib

import duckdb
import pytest

from laneflow.llm import conversations, oracle
from laneflow.llm.conversations import BLANK, CUT, DUPLICATE, FINE, Chain, cheapest

SCHEMA = "conv_id long, turn long, role string, text string, copy string, kind int"
DUE = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def forward(kinds):
    """The cheapest way to every state, row by row: what the search has to find."""

    def inserted(ways):
        for _ in range(4):
            for s in list(ways):
                way = (ways[s][0] + 5, ways[s][1] + "I")
                ways[DUE[s]] = min(way, ways.get(DUE[s], way))
        return ways

    ways = inserted({0: (0, "")})
    for initial, fault in kinds:
        found = {}
        for s, (cost, letters) in ways.items():
            options = [(s, 2, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = 5 if fault == CUT else 0
                options.append((DUE[s], 1 + extra, "R"))
                if (s, initial) in KEPT:
                    options.append((KEPT[s, initial], extra, "K"))
            for state, more, letter in options:
                way = (cost + more, letters + letter)
                found[state] = min(way, found.get(state, way))
        ways = inserted(found)
    return min(ways[s] for s in (0, 3) if s in ways)


def some(draw, n):
    return [(draw.choice(["s", "u", "u", "a", "a", " ", "x", ""]), draw.choice([FINE, FINE, FINE, BLANK, DUPLICATE, CUT])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_the_search_finds_the_least_of_the_cheapest(seed):
    draw = random.Random(seed)
    for _ in range(150):
        kinds = some(draw, draw.choice([0, 1, 2, 3, 5, 8, 13, 21]))
        assert cheapest(kinds) == forward(kinds), kinds


@pytest.mark.parametrize("stretch", [1, 2, 3, 7])
def test_stretches_chain_to_the_same_edits(stretch):
    draw = random.Random(stretch)
    for _ in range(100):
        kinds, chain = some(draw, draw.choice([0, 1, 4, 9, 20])), Chain(stretch)
        for kind in kinds:
            chain.add(*kind)
        assert chain.result() == forward(kinds), kinds


def test_a_long_conversation():
    draw = random.Random(5)
    kinds, chain = some(draw, 1500), Chain()
    for kind in kinds:
        chain.add(*kind)
    assert chain.result() == forward(kinds)


def test_letters_by_hand():
    assert cheapest([]) == (0, "")
    assert cheapest([("s", FINE)]) == (2, "D")
    assert cheapest([("u", FINE), ("a", FINE)]) == (0, "KK")
    assert cheapest([("u", FINE)]) == (2, "D")
    assert cheapest([("u", FINE), ("u", FINE)]) == (1, "KR")
    assert cheapest([("u", FINE), ("a", CUT)]) == (4, "DD")  # keeping would cost 5
    assert cheapest([("u", BLANK), ("u", FINE), ("a", FINE)]) == (2, "DKK")


def rows_of_a_table(seed=0, conversations_=60):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "Well then!", " ", "", None, "a\nb?", "x. \t", "end. ", "x" * 5000 + "."]
    rows = []
    for c in range(conversations_):
        for t in range(draw.choice([1, 1, 2, 3, 6, 9])):
            turn = draw.choice([t, t, t, t + 2, None])
            rows.append((c, turn, draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(texts), "c", 1))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.", "c", 1) for t in range(300)]
    rows += [(None, 0, "user", "Hm.", "c", 1), (None, 1, "assistant", "Ah.", "c", 1)]
    rows += [(901, 1, "user", "Same.", "c", 1)] * 200 + [(901, 2, "assistant", "Other.", "c", 1)]
    return rows


def test_the_audit_equals_its_sql_on_odd_rows(spark, tmp_path):
    frame = spark.createDataFrame(rows_of_a_table(), SCHEMA).repartition(3)
    frame.write.parquet(str(tmp_path / "t"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/t/*.parquet')")
    expected = connection.execute(oracle.CONVERSATION_AUDIT)
    names = [c[0] for c in expected.description]
    want = sorted(expected.fetchall(), key=str)
    got = sorted((tuple(r[n] for n in names) for r in conversations.audit_damaged(frame).collect()), key=str)
    assert got == want


def test_damage_by_the_checksum(spark):
    rows = [(c, t, None if t == 3 else "assistant", "One. Two! Three?", "c", 1) for c in range(40) for t in (0, 3, None)]
    got = {}
    for r in conversations.damage(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["copy"], r["kind"]))
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if kind == 4 else " " if role is None else role
        text = "" if kind == 1 else "One Two Three" if kind == 2 else text
        assert got.get((c, t), []) == [(role, text, "c", 1)] * {0: 0, 3: 2}.get(kind, 1)


def test_repaired_rows_are_sound_and_hash_to_the_digest(spark):
    frame = conversations.damage(spark.createDataFrame(rows_of_a_table(3), SCHEMA).repartition(3))
    rows = {}
    for r in conversations.repair(frame).collect():
        rows.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for r in conversations.digests(frame).collect():
        own = sorted(rows.get(r["conv_id"], []))
        assert [p for p, *_ in own] == list(range(len(own)))
        initials = "".join(role[:1] for _, role, _ in own)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"
        text = "\n".join(f"{role}:{text}" for _, role, text in own)
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["audit"].count("K") + r["audit"].count("R") + r["audit"].count("I") == len(own)


def test_gaps_and_counts(spark):
    rows = [(1, t, "user", x, "c", 1) for t, x in ((-2, "a."), (0, "a."), (0, " "), (5, "b"), (None, "c!"))]
    rows += [(2, None, "user", "a.", "c", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r.asDict() for r in conversations.plan(frame).collect()}
    assert {k: got[1][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")} == {
        "gaps": 5, "blank": 1, "duplicate": 1, "truncated": 1, "illegal": 4
    }
    assert got[2]["gaps"] == 0 and got[2]["cost"] == 2 and got[2]["audit"] == "D"


def test_no_rows_and_ids_of_text(spark):
    assert conversations.audit_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert [(r["conv_id"], r["audit"]) for r in conversations.plan(rows).collect()] == [("x", "KK")]
