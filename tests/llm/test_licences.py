from laneflow.llm import licences


def scan(spark, docs):
    return licences.scan(
        docs, licences.texts_of(spark, licences.LICENCES), licences.texts_of(spark, licences.NOTICES)
    )


def test_whole_texts_match_whatever_their_dress(spark, documents):
    mit, bsd = licences.LICENCES["MIT"], licences.LICENCES["BSD-3-Clause"]
    rows = [
        (1, mit), (2, mit.upper().replace(",", ";")), (3, mit.replace("<year> <holder>", "1999-2024 Somebody & Sons, Ltd.")),
        (4, "All rights reserved.\n" + mit.replace("License", "Licence").replace("sublicense", "sublicence") + "\n\n"),
        (5, mit + " And one more word"), (6, bsd.replace("\n", "\r\n")), (7, mit.replace("Permission", "No permission")),
        (8, None), (9, ""), (10, "Copyright (c) 2020 Me"), (11, "  released under the mit LICENSE\nprose about licences"),
        (12, "x\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (13, "It says: Released under the MIT License."), (None, mit), (1, mit), (14, "a b " * 100_000),
    ]
    found = {}
    result = scan(spark, documents(rows, extra=("digest", "licence", "known_as", "_row"))).collect()
    assert len(result) == len(rows)
    for r in result:
        found[r["doc_id"]] = (r["licence"], r["notices"])
    assert [found[i][0] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None)] == [
        "MIT", "MIT", "MIT", "MIT", None, "BSD-3-Clause", None, None, None, None, "MIT"]
    assert (found[11][1], found[12][1], found[13][1], found[14][1]) == ("MIT", "CC-BY-NC-4.0,MIT", "", "")


def test_licences_are_told_apart_and_shared_texts_named_together(spark):
    known = licences.known_digests(licences.texts_of(spark, licences.LICENCES)).collect()
    assert sorted(r["known_as"] for r in known) == sorted(licences.LICENCES)
    both = licences.known_digests(licences.texts_of(spark, {"b": "Some Text.", "a": "some text"})).collect()
    assert [r["known_as"] for r in both] == ["a,b"]


def test_empty_table(spark, documents):
    assert scan(spark, documents([])).collect() == []


def test_line_breaks_do_not_count(spark, documents):
    import textwrap

    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))

    texts = [(name, wrapped(text, width)) for name, text in licences.LICENCES.items() for width in range(35, 121)]
    texts += [("MIT", licences.LICENCES["MIT"].replace("(c) <year> <holder>", h)) for h in ("Some Body and others", "Law Offices 2010")]
    assert any(line.lower().startswith("copyright notice") for _, t in texts for line in t.split("\n"))
    found = {r["doc_id"]: r["licence"] for r in scan(spark, documents([(i, t) for i, (_, t) in enumerate(texts)])).collect()}
    assert [found[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_sql_of_the_same_rule(spark, documents, tmp_path):
    import textwrap

    import duckdb

    broken = lambda text, w: "\n\n".join(textwrap.fill(p, w) for p in text.split("\n\n"))
    wrapped = [broken(text, w) for text in licences.LICENCES.values() for w in (35, 48, 61, 77)]
    lines = [
        "copyright notice", "Copyright holders 2010", "copyright\tholder (c) x", "copyright  ", "copyright", "-- copyright x", "© copyright notice",
        "(c) notice", "* (C) 2020", "all rights reserved.", "x all rights reserved", "copyrights 2010", "copyright laws of 1999b", "copyright owner ©",
        "copyright licences apply\r", "COPYRIGHT\r", "  copyright noticed 3", "copyright interests", "licence copyright 2010",
    ]
    texts = [*wrapped, *licences.LICENCES.values(), *licences.NOTICES.values(), None, "", "\n\n", *lines]
    texts += ["\n".join([a, "Released under the MIT licence", b]) for a, b in zip(lines, lines[3:])]
    documents([(i, t) for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(connection.execute(licences.oracle_sql()).fetchall(), key=str)
    assert sorted((tuple(r) for r in scan(spark, frame).collect()), key=str) == want
    assert sum(r[2] is not None for r in want) >= 28
