import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from laneflow.llm import divergence, oracle

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    """Every kept term with every group, straight from the definition. Rows are (id, text, lang, source)."""
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(SMALL))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        having = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in having.items() if n >= 3)

        def shares(chosen):
            counts = Counter(t for d in chosen for t in d[2])
            total = sum(counts[t] for t in kept)
            return counts, {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        groups = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        _, whole = shares(mine)
        f = lambda p, q: (p - q) * (p - q) // q
        for s, (counts, p) in groups.items():
            pairs = [(-sum(f(p[t], q[t]) for t in kept), h.encode()) for h, (_, q) in groups.items() if h != s]
            terms = [(-f(p[t], whole[t]), t.encode()) for t in kept if counts[t] > 0 and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def found(frame, **options):
    return sorted(tuple(r) for r in divergence.divergence(frame, **options).collect())


def table(seed, n=150, sources=7):
    draw = random.Random(seed)
    words = ["the", "The", "THE", "of", "ÉTÉ", "été", "ß", "x", "日本", "don't", "a_b", "q1r", "[é]", "z{y}"]
    words += [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(90)]
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words[: draw.choice([5, 30, 104])]) for _ in range(draw.choice([0, 1, 5, 40])))
        source = draw.choice(["hot", "hot", None, "", *[f"s{j}" for j in range(sources)]])
        rows.append((i, draw.choice([text, text, text, None, "12 _ !"]), draw.choice(["en", "en", "en", "de", "", None]), source))
    rows += [(500, "alone", "xx", "only"), (501, "\x00\x7f", "yy", "a"), (502, None, "yy", "b")]
    rows += [(503, rows[0][1], "en", "hot")] * 60  # repeated rows
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, documents, seed):
    rows = table(seed)
    assert found(documents(rows, extra=("term", "n", "rank", "part"))) == brute(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_sources_in_several_blocks(spark, documents, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = table(9, 60)
    assert found(documents(rows)) == brute(rows)


def test_ties_are_cut_in_the_order_of_bytes(spark, documents):
    # In `a`, 300 terms have equal counts: only the first by bytes get a rank.
    names = [chr(0x61 + i // 20) + chr(0x61 + i % 20) for i in range(280)] + [chr(0xE0 + i) for i in range(20)]
    rows = [(i, " ".join(names), "en", "a") for i in range(3)] + [(9, "zz zz zz", "en", "b")] * 3
    want = brute(rows)
    got = found(documents(rows))
    assert got == want
    terms = [r for r in got if r[1:3] == ("a", "term")]
    assert len(terms) == 200 and sorted(r[5] for r in terms) == list(range(1, 201))


def test_long_texts_are_counted_in_slices(spark, documents, monkeypatch):
    rows = [(i, ("ab cd, " * 3000) + "é" * 5000 + " end", "en", f"s{i % 2}") for i in range(4)]
    want = brute(rows)
    monkeypatch.setattr(divergence, "SLICE", 64)
    assert b" ".join(w for part in divergence._words(rows[0][1].encode()) for w in part).decode().split() == TERM.findall(rows[0][1])
    assert found(documents(rows)) == want


def test_counts_are_passed_on_when_many_are_held(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 5)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "b", "a", "a"], "text": [b"x y z", b"x", b"x x q", b""]})
    out = Counter()
    for part in divergence._count(iter([batch])):
        for r in part.to_pylist():
            out[r["source"], r["term"]] += r["n"]
    assert {k: v for k, v in out.items() if k[1]} == {("a", b"x"): 3, ("a", b"y"): 1, ("a", b"z"): 1, ("a", b"q"): 1, ("b", b"x"): 1}
    assert ("a", b"") in out and ("b", b"") in out


def test_sql_of_the_same_and_no_rows(spark, documents, tmp_path):
    rows = table(4)
    frame = documents(rows)
    frame.write.parquet(str(tmp_path / "d"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(connection.execute(oracle.SOURCE_DIVERGENCE).fetchall()) == found(frame)
    assert found(frame.where(F.lit(False))) == []
