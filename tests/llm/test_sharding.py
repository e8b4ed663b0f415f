import zlib

from laneflow.llm import sharding


def check(rows, found, shards=24):
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, []).append((text or "").encode())
    assert len(found) == len(rows)
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in found:
        t = texts[r["doc_id"]][0] if len(texts[r["doc_id"]]) == 1 else None
        if t is not None:
            assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(r["size"] for r in found)
    assert all(abs(s - sum(sizes) / shards) <= largest for s in sizes)


def test_shards_are_equal_but_for_one_document(documents, words):
    w = words(3)
    rows = [(i, w.text(w.random.randint(1, 80))) for i in range(500)]
    rows += [(1000 + i, "the same text") for i in range(300)]  # a third of the rows is one text
    rows += [(2000, None), (2001, ""), (2002, "ü" * 5000), (None, "no id"), (None, "no id"), (7, rows[7][1])]
    docs = documents(rows, extra=("size", "shard", "_key"))
    found = sharding.shard(docs).collect()
    check(rows, found)
    copies = {r["shard"] for r in found if 1000 <= (r["doc_id"] or 0) < 1300}
    assert len(copies) <= 3


def test_overfull_ranges_are_cut_again(documents, words):
    w = words(4)
    rows = [(i, w.text(20)) for i in range(400)]
    check(rows, sharding.shard(documents(rows), least_ranges=24, oversample=1).collect())


def test_few_rows_and_none(documents):
    check([(1, "one"), (2, "two")], sharding.shard(documents([(1, "one"), (2, "two")])).collect())
    assert sharding.shard(documents([])).collect() == []


def test_range_lookup(spark):
    from pyspark.sql import functions as F

    bounds = ["B", "D", "F"]
    rows = spark.createDataFrame([(k,) for k in "ABCDEFG"], "k string")
    found = {r[0]: r[1] for r in rows.select("k", sharding.range_of(F.col("k"), bounds)).collect()}
    assert found == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 2, "F": 3, "G": 3}
    assert sharding.quantiles([], 4) == [] and sharding.quantiles("aaaa", 4) == ["a"]
