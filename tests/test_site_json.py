import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from laneflow import sources
from laneflow.schemas import CHARACTERISTIC_FIELDS, CHARACTERISTICS, SITE_DICTIONARY_SCHEMA, SITE_FIELDS
from laneflow.sources.json_members import read_object_members


def dictionary(n, seed=0, start=0):
    """Sites with all that can mislead a search for braces."""
    draw = random.Random(seed)
    odd = ["plain", 'quote " inside', "brace { open", "brace } close", "}}}", '{"a": {', "back\\slash", 'end\\"', "\\", "é日", "line\nbreak", ""]
    sites = {}
    for i in range(start, start + n):
        key = f"S{i}" + draw.choice(["", "", ' "}', "{", "\\"])
        entry = {name: draw.choice([*odd, None]) for name in SITE_FIELDS}
        entry["measurementSiteId"] = key
        entry[CHARACTERISTICS] = {
            str(j): {name: draw.choice(odd) for name in CHARACTERISTIC_FIELDS} for j in range(draw.choice([0, 1, 3]))
        }
        sites[key] = entry
    return sites




def expected(content):
    return sorted(
        (tuple(e[n] for n in SITE_FIELDS), sorted((k, tuple(v[n] for n in CHARACTERISTIC_FIELDS)) for k, v in e[CHARACTERISTICS].items()))
        for e in content.values()
    )


def key(found):
    return sorted(map(repr, found))


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.mark.parametrize("layout", [{"indent": 4}, {"indent": 0}, {}, {"separators": (",", ":")}, {"indent": "\t", "ensure_ascii": False}])
def test_one_object_is_read_by_many_tasks(spark, write, small_splits, layout):
    content = dictionary(150, seed=len(str(layout)))
    path = write({"sites.json": json.dumps(content, **layout)})
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
    found = sources.read_site_dictionary(spark, path)
    assert key(rows_(found)) == key(expected(content))
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SITE_DICTIONARY_SCHEMA)))
    assert found.count() == whole.count() == 150


def rows_(frame):
    return [
        (tuple(r[n] for n in SITE_FIELDS), sorted((k, tuple(v)) for k, v in r[CHARACTERISTICS].items())) for r in frame.collect()
    ]


def test_files_of_different_layouts_give_every_site(spark, write, small_splits):
    parts = [dictionary(20, seed=i, start=100 * i) for i in range(6)]
    by_line = "{\n" + ",\n".join(json.dumps({k: v})[1:-1] for k, v in parts[0].items()) + "\n}\n"
    head = '{"first": ' + json.dumps(parts[1].pop(next(iter(parts[1])))) + ",\n"
    path = write({
        "a.json": by_line,
        "b.json": head + ",\n".join(json.dumps({k: v})[1:-1] for k, v in parts[1].items()) + "}",
        "c.json": json.dumps(parts[2]),
        "d d.json": json.dumps(parts[3], indent=4) + "\n",
        "e.json": json.dumps(parts[4], indent=2) + json.dumps(parts[5]) + " \n\n",
        "f.json.gz": gzip.compress(json.dumps(dictionary(5, start=900), indent=1).encode()),
        "g.json": " \n",
        "h.json": "{ }",
        "i.json": "{\n}\n",
    })
    found = [r[0][0] for r in rows_(sources.read_site_dictionary(spark, path))]
    want = [e["measurementSiteId"] for p in parts for e in p.values()] + list(dictionary(5, start=900))
    assert len(found) == 125 and set(want) <= set(found)


def test_the_sites_of_the_second_layout_are_not_lost(spark, write):
    entry = json.dumps({**{n: "x" for n in SITE_FIELDS}, CHARACTERISTICS: {}})
    path = write({"1.json": '{\n"a":' + entry + "\n}\n", "2.json": '{"b":' + entry + "}"})
    assert sources.read_site_dictionary(spark, path).count() == 2
    one = write({"1.json": '{"a":' + entry + ',\n"b":' + entry + "\n}\n"}, "one")
    assert sources.read_site_dictionary(spark, one).count() == 2


def test_an_object_over_several_files_is_read_beside_another_layout(spark, write):
    entry = json.dumps({**{n: "x" for n in SITE_FIELDS}, CHARACTERISTICS: {}})
    path = write({
        "part-0.json": '{\n"a":' + entry + ",\n", "part-1.json": '"b":' + entry + ",\n", "part-2.json": '"c":' + entry + "\n}\n",
        "whole.json": '{"d":' + entry + ', "e":' + entry + "}",
    })
    assert sources.read_site_dictionary(spark, path).count() == 5


GOOD = '{"measurementSiteId": "x", "latitude": "1"}'


@pytest.mark.parametrize("text", [
    '{"a": ' + GOOD, '{"a": {"latitude": "1"}\n', '{"a": {"latitude": "1}}', '{"a": ' + GOOD + '} }', '{"a": ' + GOOD + ' "b": ' + GOOD + "}",
    '{"a": ' + GOOD + ', "b": ' + GOOD + ', "c"}', "[" + '{"a": ' + GOOD + "}]", '{"a": ' + GOOD + "} trailing", 'x{"a": ' + GOOD + "}",
])
def test_what_is_no_dictionary_fails(spark, write, text):
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        sources.read_site_dictionary(spark, write({"s.json": text})).collect()


def test_members_with_other_values(spark, write):
    path = write({"s.json": '{"a": null, "b": {"x": 1}, "c": [1, {"d": 2}], "e": "}", "f": 3}'})
    found = [json.loads(r["value"]) for r in read_object_members(spark, path).collect()]
    assert {k: v for m in found for k, v in m.items()} == {"a": None, "b": {"x": 1}, "c": [1, {"d": 2}], "e": "}", "f": 3}
