import numpy as np

from laneflow.llm import quality
from tests.llm.conftest import kept_back


def corpus(words):
    rows, labels = [], []
    for i in range(400):
        w = words(i)
        if i % 4:
            text = w.text(w.random.randint(20, 200))
        else:
            kind = w.random.randint(0, 2)
            many = w.random.randint(20, 200)
            text = [" ".join([w.word()] * many), " ".join(w.word() + "%%%" for _ in range(many)), w.text(many).upper() + "!!"][kind]
        rows.append((i, text))
        labels.append((i, int(i % 4 > 0), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, documents, words):
    rows, labels = corpus(words)
    extra = [(9000, None), (9001, ""), (9002, "x" * 300_000), (None, rows[1][1]), (0, rows[0][1])]
    docs = documents(rows + extra, extra=("score", "predicted", "_id", "_label"))
    marks = spark.createDataFrame(labels + [(5, 0, 0), (None, 1, 0), (6, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, marks, dictionary_bytes=16_384)
    found = quality.classify(docs, model).collect()
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    by_id = {r["doc_id"]: r["predicted"] for r in found}
    held = [r for r in labels if kept_back(r[0])]
    assert len(held) > 50
    assert sum(by_id[i] == q for i, q, _ in held) >= 0.93 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in found if r["predicted"])


def test_held_out_labels_do_not_matter(spark, documents, words):
    rows, labels = corpus(words)
    docs = documents(rows)
    turned = [(i, 1 - q if kept_back(i) else q, t) for i, q, t in labels]
    models = [quality.learn(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned)]
    assert models[0] == models[1]


def test_one_class_or_nothing(spark, documents, words):
    docs = documents([(1, words(1).text(30)), (4, None)])
    for labels in ([], [(1, 1, 0)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        scores = {r["score"] for r in quality.classify(docs, quality.learn(docs, marks)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(documents([]), quality.learn(documents([]), marks)).collect() == []


def test_calibration_finds_the_curve():
    draw = np.random.default_rng(1)
    x = draw.normal(size=20_000)
    y = (draw.random(20_000) < 1 / (1 + np.exp(-(3 * x + 1)))).astype(float)
    slope, offset = quality.calibrate(x, y)
    assert abs(slope - 3) < 0.15 and abs(offset - 1) < 0.1


def test_whole_text_counts():
    good, bad = quality.compressors([b"the and of to " * 50]), quality.compressors([b"%%% &&& ### $$$ " * 50])
    clean = "the and of to " * 400
    assert quality.difference(clean, good, bad, 2000) > quality.difference(clean + "%%% &&& ### $$$ " * 400, good, bad, 2000)
    assert quality.difference(None, good, bad, 2000) == quality.difference("", good, bad, 2000) == 0
