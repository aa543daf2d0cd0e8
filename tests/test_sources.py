"""Sources and sinks on small constructed files."""

import json

import pytest
from pyspark.sql import functions as F

from matchledger.operators.validate import Issues
from matchledger.sources import landed, policy, preformatted, records, sinks

SCHEMA = "id string, season int, home struct<club string, score int>, events array<struct<minute int, type string>>"


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


GOOD = {"id": "a", "season": 1998, "home": {"club": "x", "score": 2}, "events": [{"minute": 3, "type": "goal"}]}


def test_records_and_issues(spark, tmp_path, schema):
    folder = write(tmp_path / "m", a=GOOD, b="{not json", c={**GOOD, "home": {"club": "x", "colour": "red"}, "events": [{"minute": 1, "kind": "goal"}]}, d={"season": 1999}, e={**GOOD, "season": "late"}, f="[]", g="")
    good, issues = records.parsed(records.scan(spark, folder), schema, ("id",))
    assert [(r["id"], r["season"], r["home"]["score"], len(r["events"])) for r in good.collect()] == [("a", 1998, 2, 1)]
    found = {(r["path"][-6], r["field"], r["message"]) for r in issues.collect()}
    assert found == {("b", "", "unreadable"), ("c", "home.colour", "unknown key"), ("c", "events.kind", "unknown key"), ("d", "id", "required"), ("e", "", "unreadable"), ("f", "", "unreadable"), ("g", "", "unreadable")}


def test_path_must_agree(spark, tmp_path, schema):
    write(tmp_path / "1998", a=GOOD, b=GOOD)
    write(tmp_path / "1999", a=GOOD)
    good, _ = records.parsed(records.scan(spark, str(tmp_path / "*")), schema)
    found = records.misplaced(good, "([0-9]+)/([^/]+)\\.json$", "season", "id").collect()
    assert sorted((r["path"][-11:], r["field"]) for r in found) == [("1998/b.json", "id"), ("1999/a.json", "season")]


def test_yaml_keeps_dates_as_text(spark, tmp_path):
    (tmp_path / "x.yaml").write_text("id: a\ndate: 1998-08-16\nscore: 2\n")
    (tmp_path / "y.yaml").write_text("id: [\n")
    files = records.from_yaml(records.scan(spark, str(tmp_path), pattern="*.yaml"))
    good, issues = records.parsed(files, spark.createDataFrame([], "id string, date string, score int").schema)
    assert [tuple(r)[1:] for r in good.collect()] == [("a", "1998-08-16", 2)]
    assert [r["message"] for r in issues.collect()] == ["unreadable"]


def test_json_items_and_bindings(spark):
    body = json.dumps({"a": {"list": [{"n": 1, "s": "x"}, {"n": None, "other": 5}]}, "results": {"bindings": [{"p": {"value": "Q1"}, "name": {"value": "N"}}, {"p": {"value": "Q2"}}]}})
    df = spark.createDataFrame([(1, body), (2, "junk"), (3, None)], "id int, body string")
    assert [tuple(r) for r in landed.items(df, "body", "$.a.list", "n: int, s: string", "id").orderBy("nth").collect()] == [(1, 0, 1, "x"), (1, 1, None, None)]
    assert sorted(map(tuple, landed.bindings(df, "body", "p", "name").collect())) == [("Q1", "N"), ("Q2", None)]


def test_html_tables_by_header(spark):
    html = "<table><tr><td>junk</td></tr></table><table class=t><tr><th>Date</th><th>Home</th><th>Result</th></tr><tr><td>1.5</td><td><b>A &amp; B</b></td><td>2 - 1</td></tr><tr><td>2.5</td></tr></table>"
    rows = landed.table_rows(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html")
    found = landed.with_header(rows, "id", "Result", "Home").orderBy("row").collect()
    assert [(r["row"], r["Result"], r["Home"]) for r in found] == [(1, "2 - 1", "A & B"), (2, None, None)]


def test_infobox_words_and_templates(spark):
    html = "<table><tr><th>Born</th><td>1 May <i>1970</i></td></tr><tr><th colspan=2>Career</th></tr><tr><th>Club</th><td>X</td></tr></table>"
    xml = '<Page><TextLine><String CONTENT="A" HPOS="1" VPOS="2.5" WC="0.9"/><SP/><String CONTENT="b&amp;c" HPOS="9" VPOS="3"/></TextLine><TextLine><String CONTENT="d"/></TextLine></Page>'
    wiki = "x {{Squad player|no=1|nat={{flag|NOR}}|name=[[Ola N (player)|Ola N]]|pos=GK}} {{other|a=1}}\n{{squad player|no=2|name=[[Per]]|no=3}}"
    df = spark.createDataFrame([(1, html, xml, wiki)], "id int, html string, xml string, wiki string")
    assert [(r["label"], r["value"]) for r in landed.infobox(df, "id", "html").orderBy("nth").collect()] == [("Born", "1 May 1970"), ("Club", "X")]
    assert [(r["line"], r["nth"], r["word"], r["x"], r["y"], r["confidence"]) for r in landed.scanned_words(df, "id", "xml").orderBy("line", "nth").collect()] == [(0, 0, "A", 1.0, 2.5, 0.9), (0, 1, "b&c", 9.0, 3.0, None), (1, 0, "d", None, None, None)]
    uses = landed.templates(df, "id", "wiki", "squad player").orderBy("nth").collect()
    assert [r["parameters"] for r in uses] == [{"no": "1", "nat": "NOR", "name": "Ola N", "pos": "GK"}, {"name": "Per", "no": "3"}]


def test_preformatted_page(spark):
    page = "Round 1\n16/8:\nFK A - B 2 2-1 (after extra time)\nC - D 0-0\nRound 2\nE - F 3-3\n17/9: G - H 1-2\n\n 1. B 2   4 2 1 1 8-5 7 promoted\nC 4 4 4 4 4-4 4\n"
    df = spark.createDataFrame([(1, page), (2, "")], "id int, text string")
    found = [tuple(r)[2:] for r in preformatted.results(df, "id", "text").orderBy("nth").collect()]
    assert found == [(1, 8, 16, "FK A", "B 2", 2, 1, "(after extra time)"), (1, 8, 16, "C", "D", 0, 0, None), (2, None, None, "E", "F", 3, 3, None), (2, 9, 17, "G", "H", 1, 2, None)]
    assert [tuple(r)[1:] for r in preformatted.standings(df, "id", "text").collect()] == [(1, "B 2", 4, 2, 1, 1, 8, 5, 7, "promoted")]


def test_rights(spark):
    rows = [("a", "allowed", "allowed", "pending", "pending"), ("b", "allowed", "allowed", "granted", "blocked"), ("c", "unknown", "unknown", "granted", "pending"), ("d", "blocked", "denied", "granted", "accepted_risk"), ("e", "unknown", "unknown", "pending", "pending")]
    p = spark.createDataFrame(rows, "provider_id string, automated_access string, public_redistribution string, permission_status string, ingest_decision string")
    got = {r[0]: (r[1], r[2]) for r in p.select("provider_id", policy.may_fetch(), policy.may_publish()).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, True), "d": (False, False), "e": (False, False)}
    rows = spark.createDataFrame([("a",), ("z",), ("z",)], "source string")
    assert [tuple(r) for r in policy.refused(rows, p, "source", policy.may_publish()).collect()] == [("z", 2)]
    assert policy.require(rows.filter("source = 'a'"), p, "source", policy.may_publish()).count() == 1
    with pytest.raises(Issues, match="z"):
        policy.require(rows, p, "source", policy.may_publish())


def test_build_is_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "db")
    none = spark.createDataFrame([], "check string, key string, message string")
    one = spark.createDataFrame([("c", "k", "m")], none.schema)
    with pytest.raises(Issues):
        sinks.build({"t": spark.range(3)}, one, folder)
    with pytest.raises(Issues, match="nothing"):
        sinks.build({"t": spark.range(0)}, none, folder)
    assert sinks.stored(spark, f"{folder}/versions") is None
    sinks.build({"t": spark.range(3), "u": spark.range(0)}, none, folder)
    sinks.build({"t": spark.range(5)}, none, folder)
    assert sinks.current(spark, folder, "t").count() == 5
    with pytest.raises(Issues):
        sinks.write_plan(spark.range(1), one, str(tmp_path / "plan"))
    assert not (tmp_path / "plan").exists()


def test_change_aware_and_resumable(spark, tmp_path):
    path = str(tmp_path / "standings")
    day = lambda at, *rows: spark.createDataFrame([(k, v, at) for k, v in rows], "id int, points int, at int")
    sinks.append_changed(day(1, (1, 10), (2, None)), path, "id", "at")
    sinks.append_changed(day(2, (1, 10), (2, 5)), path, "id", "at")
    sinks.append_changed(day(3, (1, 10), (2, None), (3, 1)), path, "id", "at")
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "at").collect())) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 3)]
    todo, done = spark.range(4), str(tmp_path / "report")
    assert sinks.remaining(todo, done, "id").count() == 4
    sinks.report(todo.filter("id < 3"), done)
    assert [r[0] for r in sinks.remaining(todo, done, "id").collect()] == [3]


def test_series_and_latest(spark):
    s = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 7), ("b", None)], "s string, n int")
    assert sorted(map(tuple, landed.series_gaps(s, "s", "n").collect())) == [("a", 2, "missing"), ("a", 3, "repeated")]
    r = spark.createDataFrame([("u", 1, "old"), ("u", 2, "new"), ("v", 1, None)], "url string, at int, body string")
    assert sorted((x["url"], x["body"]) for x in landed.latest(r, "url", "at").collect()) == [("u", "new"), ("v", None)]
    assert r.select(landed.cache_key(F.col("url"))).distinct().count() == 2
