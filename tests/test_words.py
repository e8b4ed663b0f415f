from laneflow.operators import identity, words
from laneflow.sources import lines_of, read_lines


def counts(rows):
    return {row["word"]: row["n"] for row in words.word_count(rows).collect()}


def test_distinct_words(spark):
    lines = lines_of(spark, ["12123 123123", "3423"])
    assert words.word_count(words.words(lines)).count() == 3


def test_whitespace_edges(spark):
    lines = lines_of(spark, ["12123 123123", "3423", "", "   ", " a\tB "])
    assert counts(words.words(lines)) == {
        "": 5, "12123": 1, "123123": 1, "3423": 1, "a": 1, "B": 1,
    }


def test_normalised_words(spark):
    lines = lines_of(spark, ["Heart", "Diamonds Heart"])
    assert counts(words.normalised_words(lines)) == {"heart": 2, "diamonds": 1}


def test_normalised_edges(spark):
    lines = lines_of(spark, ["Heart", "Diamonds Heart", "", "   ", ' a,"B" ', ",,"])
    assert counts(words.normalised_words(lines)) == {
        "": 2, "heart": 2, "diamonds": 1, "a": 1, "b": 1,
    }


def test_sorted_by_count(spark):
    lines = lines_of(spark, ["b a b", "c b a"])
    rows = words.by_count(words.word_count(words.words(lines))).collect()
    assert [(r["n"], r["word"]) for r in rows] == [(3, "b"), (2, "a"), (1, "c")]


def test_lines_of_texts(spark):
    texts = spark.createDataFrame([("x y\n\nz",)], "text STRING")
    assert [r[0] for r in words.lines_of_texts(texts, "text").collect()] == ["x y", "", "z"]


def test_unchanged_lines(spark, write):
    path = write({"a.txt": "Heart\nDiamonds Heart\n"})
    rows = identity.unchanged(read_lines(spark, path)).collect()
    assert sorted(r["value"] for r in rows) == ["Diamonds Heart", "Heart"]
