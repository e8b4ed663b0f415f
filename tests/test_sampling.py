import random

import pytest
from pyspark.sql import functions as F

from laneflow.operators import sampling
from laneflow.sources import read_positioned_lines


def prefix(sizes, budget):
    taken, total = 0, 0
    while taken < len(sizes) and total < budget:
        total += sizes[taken]
        taken += 1
    return taken


def sample(spark, texts, budget, **options):
    rows = spark.createDataFrame(texts, "pos BIGINT, text STRING").repartition(3)
    found = sampling.byte_budget_rows(
        rows, "pos", sampling.line_bytes(F.col("text")), budget, **options
    )
    assert found.columns == ["pos", "text"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("budget", "taken"), [(0, 0), (1, 1), (5, 1), (8, 2), (10, 2), (100, 3)])
def test_three_lines(spark, budget, taken):
    texts = [(i, "four") for i in range(3)]
    assert sample(spark, texts, budget) == texts[:taken]


def test_nothing_to_sample(spark):
    assert sample(spark, [], 10) == []


@pytest.mark.parametrize("seed", range(4))
def test_narrowing_equals_running_total(spark, seed, monkeypatch):
    monkeypatch.setattr(sampling, "FANOUT", 4)
    rng = random.Random(seed)
    positions = sorted(rng.sample(range(10**6), 300))
    texts = [(p, "é" * rng.randrange(40)) for p in positions]
    sizes = [len(t.encode()) + 1 for _, t in texts]
    budget = rng.randrange(1, sum(sizes))
    expected = texts[: prefix(sizes, budget)]
    assert sample(spark, texts, budget, stretch_bytes=64) == expected


def test_most_rows_at_one_position(spark, monkeypatch):
    """A hot position is narrowed down by content, and its copies are counted out."""
    monkeypatch.setattr(sampling, "FANOUT", 4)
    texts = [(1, "a")] + [(5, f"row {i:03d}") for i in range(100)] + [(9, "z")]
    found = sample(spark, texts, 200, stretch_bytes=32)
    assert (1, "a") in found and (9, "z") not in found
    assert len(found) == 1 + prefix([8] * 100, 198)
    copies = [(1, "a")] + [(5, "copy")] * 100
    assert sample(spark, copies, 52, stretch_bytes=32) == [(1, "a")] + [(5, "copy")] * 10


@pytest.mark.parametrize("stretch_bytes", [32, 1 << 20])
def test_rows_without_position_come_last(spark, stretch_bytes):
    texts = [(None, "none")] * 3 + [(i, "four") for i in range(20)]
    rows = spark.createDataFrame(texts, "pos BIGINT, text STRING").repartition(3)
    for budget, taken in ((60, 12), (100, 20), (103, 21), (1000, 23)):
        found = sampling.byte_budget_rows(
            rows, "pos", sampling.line_bytes(F.col("text")), budget, stretch_bytes=stretch_bytes
        ).collect()
        assert len(found) == taken
        assert sum(r["pos"] is None for r in found) == max(0, taken - 20)


def lines_of_files(contents):
    return [line for _, text in sorted(contents.items()) for line in text.split("\n")[:-1]]


@pytest.mark.parametrize("budget", [1, 8, 300, 1000, 5000, 10**6])
def test_lines_of_several_split_files(spark, write, budget):
    rng = random.Random(budget)
    contents = {
        f"{name}.txt": "".join(
            f"{name}{i} {'x' * rng.randrange(30)}\n" for i in range(rng.randrange(1, 60))
        )
        for name in "abcd"
    }
    path = write(contents)
    lines = lines_of_files(contents)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        found = sampling.byte_budget_lines(spark, path, budget)
        got = [(r["position"], r["value"]) for r in found.collect()]
        splits = read_positioned_lines(spark, path).select("file_path", "split_start").distinct()
        assert splits.count() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    taken = lines[: prefix([len(line) + 1 for line in lines], budget)]
    starts = [sum(len(line) + 1 for line in taken[:i]) for i in range(len(taken))]
    assert got == list(zip(starts, taken))


def test_only_needed_files_are_read(spark, write):
    path = write({f"{i}.txt": "0123456789\n" * 10 for i in range(9)})
    found = sampling.byte_budget_lines(spark, path, 115)
    assert found.count() == 11
    assert len(found.inputFiles()) < 5


def test_preview(spark):
    rows = spark.range(100).select((99 - F.col("id")).alias("n"))
    assert [r["n"] for r in sampling.preview(rows, "n").collect()] == list(range(15))
