import json

import pytest

from laneflow import jobs
from tests.test_jams import GOLDEN
from tests.test_quality import LINES
from tests.test_xml import S1, S2, SPEEDS, site_file


@pytest.fixture
def run(spark, tmp_path):
    def _run(job, source, *options):
        target = tmp_path / f"{job}-out"
        jobs.main([job, source, str(target), *options])
        parts = sorted(target.glob("**/part-*"))
        return parts, "".join(p.read_text() for p in parts if p.suffix != ".parquet")

    return _run


def test_word_count(run, write):
    _, text = run("word-count", write({"a.txt": "b a\nb\n"}))
    assert sorted(text.splitlines()) == ["a,1", "b,2"]


def test_passthrough(run, write):
    _, text = run("passthrough", write({"a.txt": "x, y\n"}))
    assert text == "x, y\n"


def test_usable_rows(run, write, capsys):
    path = write({"a.csv": "\n".join(LINES)})
    _, text = run("usable-travel-time", path)
    assert len(text.splitlines()) == 1
    assert "rows: 1" in capsys.readouterr().out
    _, text = run("usable-speed", path)
    assert text.split(",")[17] == "55"


def test_average_speed(run, write):
    _, text = run("average-speed", write({"a.csv": "\n".join(LINES)}))
    assert text.strip() == "4,2,110.0,27.5,55.0"


def test_jams(run, write):
    _, text = run("traffic-jams", write({"a.csv": GOLDEN}))
    records = [json.loads(line) for line in text.splitlines()]
    assert len(records) == 4
    assert {r["measurementSiteId"] for r in records} == {"S1", "S2", "S6"}


def test_jam_document(run, write):
    _, text = run("traffic-jams", write({"a.csv": GOLDEN}), "--document", "--speed-low", "0")
    assert len(json.loads(text)) == 3


def test_convert(run, write, capsys):
    _, text = run("convert", write({"a.xml": SPEEDS}))
    assert sorted(text.splitlines())[0] == "S1,1,2017-01-01T10:00:00Z,TrafficFlow,720"
    out = capsys.readouterr().out
    assert "'written': 3" in out and "'errors': 1" in out


def test_convert_with_sites_feeds_jams(run, write, tmp_path):
    site_path = write({"s.xml": site_file(S1, S2)}, "sites")
    _, dictionary = run("site-dictionary", site_path)
    assert set(json.loads(dictionary)) == {"S1", "S2"}
    json_path = write({"s.json": json.dumps(json.loads(dictionary), indent=4)}, "json")
    speeds = write({"a.xml": SPEEDS})
    _, as_written = run("convert", speeds, "--sitejson", str(tmp_path / "site-dictionary-out"))
    (tmp_path / "convert-out").rename(tmp_path / "first-out")
    _, text = run("convert", speeds, "--sitejson", json_path)
    assert "lessThan 5.60" in text and sorted(text.splitlines()) == sorted(as_written.splitlines())
    parts, _ = run("traffic-jams", str(tmp_path / "convert-out"), "--fields", "13")
    assert parts


def test_sample(run, write):
    _, text = run("sample", write({"a.txt": "four\nfour\nfour\n"}), "--bytes", "8")
    assert text == "four\nfour\n"


def test_ingest(run, write, spark, tmp_path):
    site_path = write({"s.xml": site_file(S1, S2)}, "sites")
    run("ingest", write({"a.xml": SPEEDS}), "--sitexml", site_path, "--once")
    rows = spark.read.parquet(str(tmp_path / "ingest-out"))
    assert rows.count() == 3 and "snapshot" in rows.columns


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_ingested_snapshots_feed_jams_with_speed_limits(run, write, spark, tmp_path, kind):
    """XML snapshots, one of them twice, through ingest to jams; the limit comes from road points."""
    site_path = write({"s.xml": site_file(S1, S2)}, "sites")
    points = str(tmp_path / "roads")
    spark.createDataFrame(
        [("w1", "80", "primary", 52.0, 4.5)], "way_id string, maxspeed string, highway string, latitude double, longitude double"
    ).write.parquet(points)
    landing = write({"a.xml": SPEEDS, "again.xml": SPEEDS}, "landing")
    run("ingest", landing, "--sitexml", site_path, "--roads", points, "--once", "--format", kind,
        "--repeats-within", "1 hour")
    out = str(tmp_path / "ingest-out")
    if kind == "csv":
        lines = [r["value"] for r in spark.read.text(out).collect()]
    else:
        lines = [",".join(str(r[c]) for c in r.asDict() if c not in ("enriched", "snapshot", "snapshot_time"))
                 for r in spark.read.parquet(out).collect()]
    assert len(lines) == 3
    assert sum("52.0,4.5,80,2,lane1" in line for line in lines) == 2
    parts, _ = run("traffic-jams", out, "--fields", "13", "--format", kind, "--min-flow", "0")
    assert parts


def test_wrong_layout_fails(run, write):
    thirteen = ",".join(["S1", "1", "t", "TrafficSpeed", "33", "n", "52", "4", "80", "2", "lane1", "60", "anyVehicle"])
    with pytest.raises(Exception, match="fields"):
        run("traffic-jams", write({"a.csv": thirteen + "\n"}))
