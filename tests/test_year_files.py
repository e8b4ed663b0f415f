import datetime

import pytest
from pyspark.sql import functions as F

from laneflow import sources
from laneflow.operators import profile


def test_years_of_differing_layouts(spark, tmp_path):
    folder = str(tmp_path / "t")
    one = spark.createDataFrame([(1, 1.5, datetime.date(2015, 1, 1))], "id int, x float, day date")
    one.selectExpr("id", "x", "day", "cast(1.25 as decimal(5,2)) d").write.parquet(f"{folder}/tweets-2014.parquet")
    two = spark.createDataFrame([(2**40, 2.5)], "id long, x double")
    two.selectExpr("id", "x", "timestamp_ntz'2016-01-01 01:00:00' day", "cast(1000.125 as decimal(8,3)) d", "'new' text").write.parquet(f"{folder}/2015.parquet")
    three = spark.createDataFrame([(7, "a", 1)], "id short, text string, likes int")
    three.coalesce(1).write.parquet(f"{folder}/sub/y2016_all.parquet")
    rows = sources.read_parquet_year_files(spark, folder)
    assert dict(rows.dtypes) == {"id": "bigint", "x": "double", "day": "timestamp_ntz", "d": "decimal(8,3)", "text": "string", "likes": "int", "year": "bigint"}
    found = {r["year"]: r.asDict() for r in rows.collect()}
    assert found[2014]["x"] == 1.5 and found[2014]["day"] == datetime.datetime(2015, 1, 1) and found[2014]["text"] is None
    assert found[2015]["id"] == 2**40 and str(found[2015]["d"]) == "1000.125"
    assert found[2016] == {"id": 7, "x": None, "day": None, "d": None, "text": "a", "likes": 1, "year": 2016}


def test_files_of_other_years_are_not_opened(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(f"{folder}/2015.parquet")
    (tmp_path / "t" / "2016.parquet").write_bytes(b"no parquet at all")
    assert sources.read_parquet_year_files(spark, folder, years=[2015]).count() == 3
    with pytest.raises(Exception):
        sources.read_parquet_year_files(spark, folder).count()
    with pytest.raises(ValueError, match="2017"):
        sources.read_parquet_year_files(spark, folder, years=[2017])


def test_types_that_do_not_go_together(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(1).selectExpr("'a' id").write.parquet(f"{folder}/2015.parquet")
    spark.range(1).write.parquet(f"{folder}/2016.parquet")
    with pytest.raises(ValueError, match="id"):
        sources.read_parquet_year_files(spark, folder)


def test_totals_and_missing_values_are_told_apart(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1), (None, None), ("total", 2)], "`by.x` string, y int")
    found = sorted((tuple(r) for r in profile.group_totals(rows, "by.x", "y").collect()), key=str)
    assert found == sorted([
        ("by.x", "a", 2), ("by.x", None, 2), ("by.x", "total", 1), ("y", "1", 2), ("y", "2", 1), ("y", None, 2), ("total", None, 5),
    ], key=str)
    assert [tuple(r) for r in profile.group_totals(rows).collect()] == [("total", None, 5)]
    empty = profile.group_totals(rows.where(F.lit(False)), "y").collect()
    assert empty == []
    plan = profile.group_totals(rows, "by.x", "y")._jdf.queryExecution().toString()
    assert plan.count("Expand") >= 1 and "Union" not in plan
