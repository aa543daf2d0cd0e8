import json

import pytest
from pyspark.sql import functions as F

from matchledger.operators import provenance, trees

LOST = trees.Additivity()


def lost(base, head):
    return [(path, change) for path, change, _, _ in LOST.lost(base, head)]


@pytest.mark.parametrize(
    ("base", "head", "want"),
    [
        ({"a": None, "b": "", "c": [], "d": " "}, {}, []),  # nothing to lose
        ({"a": {}}, {}, [("/a", "remove")]),
        ({"a": 1}, {"a": 1.0, "b": 2}, []),
        ({"a": 1}, {"a": True}, [("/a", "mutate")]),
        ({"a": 0}, {"a": None}, [("/a", "remove")]),
        ({"a": [1]}, {"a": {"0": 1}}, [("/a", "mutate")]),
        ({"a": {"b": 1}}, {"a": "b"}, [("/a", "mutate")]),
        ([1, 1, 2], [2, 1], [("[1]", "remove")]),  # as often as before
        ([[1, 2]], [[1, 2, 3]], [("[0]", "remove")]),
        ([None], [1], [("[0]", "remove")]),
        ([{"x": 1}], [{"x": 1, "y": 2}], [("[0]", "remove")]),  # nothing identifies it
        ([{"id": "p", "x": 1}], [{"id": "p", "x": 1, "y": 2}], []),
        ([{"id": "p", "x": 1}], [{"id": "p", "x": 3}], [("/id=p/x", "mutate")]),
        ([{"id": "p", "x": 1}], [{"id": "q", "x": 1}], [("/p", "remove")]),
        ([{"id": 7, "x": 1}, {"id": 7, "x": 2}], [{"id": 7, "x": 2}, {"id": 7, "x": 1}], []),  # two of one name, in another order
        ([{"id": 7, "x": 1}, {"id": 7, "x": 2}], [{"id": 7, "x": 2}, {"id": 7, "x": 9}], [("/id=7/x", "mutate")]),
        ([{"sourceId": "s", "page": 1, "t": "a"}], [{"sourceId": "s", "page": 2, "t": "a"}], [("/s:1", "remove")]),
        ([{"personId": "p", "observedTitle": "chair", "body": "board"}], [{"personId": "p", "observedTitle": "cashier", "body": "board"}], [("/p:board:chair", "remove")]),
        ([{"id": " ", "no": 3, "x": 1}], [{"no": 3, "x": 1}], []),
        ([{"id": "gone", "no": 3, "x": 1}], [{"no": 3, "x": 2}], [("/no=3/id", "remove"), ("/no=3/x", "mutate")]),  # its second name still meets one
        ({"name": "Bj�rn"}, {"name": "Bjørn"}, []),
        ({"name": "Bj�rn"}, {"name": "Bjern"}, [("/name", "mutate")]),
        ({"ref": {"retrievedAt": 1, "url": "u"}}, {"ref": {"retrievedAt": 2, "url": "v"}}, [("/ref/url", "mutate")]),
        ({"status": "scheduled"}, {"status": "played"}, []),
        ({"status": "played"}, {"status": "scheduled"}, [("/status", "mutate")]),
        ({"x": {"status": "scheduled"}}, {"x": {"status": "played"}}, [("/x/status", "mutate")]),
    ],
)
def test_losses_of_a_record(base, head, want):
    assert lost(base, head) == want


def test_very_deep_trees():
    def deep(n, leaf):
        return {"a": deep(n - 1, leaf)} if n else leaf

    assert lost(deep(trees.DEPTH, 1), deep(trees.DEPTH, 2)) == [("/a" * trees.DEPTH, "mutate")]
    assert lost(deep(trees.DEPTH + 1, 1), deep(trees.DEPTH + 1, 2)) == []


def test_losses_between_snapshots(spark):
    base = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1}'), (3, "not json"), (4, None), (5, "{}"), (None, '{"a": 1}')], "k int, tree string")
    head = spark.createDataFrame([(1, '{"a": 2}'), (3, "{}"), (9, '{"a": 1}')], "k int, tree string")
    want = [(1, "/a", "mutate", "1", "2"), (2, "", "remove", '{"a":1}', None), (5, "", "remove", "{}", None)]
    assert sorted(map(tuple, trees.losses(base, head, "k", "tree").collect())) == want
    variant = lambda df: df.select("k", F.try_parse_json("tree").alias("tree"))
    assert sorted(map(tuple, trees.losses(variant(base), variant(head), "k", "tree").collect())) == want
    assert trees.losses(base.limit(0), head, "k", "tree").count() == 0


def test_nodes_and_objects(spark):
    tree = {"title": "shots", "stats": [3, 4], "in": [{"title": "x", "stats": [1]}, {"deep": {"stats": [5, 6], "title": "corners"}}, {"title": 7, "stats": [1, 2]}], "n": None, "r": 1.5}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "{"), (4, "null"), (1, json.dumps(tree))], "k int, tree string")
    walked = trees.nodes(df, "k", "tree")
    rows = {r["path"]: r for r in walked.filter("k = 1").collect()}
    assert (rows[""]["type"], rows[""]["size"], rows["/n"]["type"], rows["/r"]["type"], rows["/in/1/deep/title"]["value"], rows["/stats"]["size"]) == ("object", 5, "null", "real", "corners", 2)
    assert walked.filter("k = 1").count() == 2 * len(rows) and [tuple(r) for r in walked.filter("k > 1").collect()] == [(4, "", None, None, "null", None, "null")]
    found = trees.objects_with(walked, "k", {"title": "text", "stats": "array(2)"})
    assert sorted(map(tuple, found.collect())) == [(1, "", "shots", "[3,4]"), (1, "/in/1/deep", "corners", "[5,6]")]


def test_copied_paths(spark):
    kind = "struct<score: struct<home: int, away: int>, note: string>"
    rows = [((None, "a"), ((1, 2), "b")), (((3, None), None), (None, "b")), (None, ((1, 2), "b")), (((3, 4), "x"), None)]
    got = trees.copied(spark.createDataFrame(rows, f"s {kind}, t {kind}"), "s", "t", ["score.home", "note"]).select("t.score.home", "t.score.away", "t.note").collect()
    assert [tuple(r) for r in got] == [(1, 2, "a"), (3, None, None), (1, 2, "b"), (3, None, "x")]


def test_removed_records(spark):
    kind = "k int, parts array<string>"
    base = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None), (5, ["x", "a"]), (6, ["b", "b", None]), (7, ["q"]), (8, ["z"]), (None, ["a"])], kind)
    head = spark.createDataFrame([(7, []), (12, ["a"]), (11, ["a", "b", "c"]), (20, ["a", "b"]), (None, ["x", "a"])], kind)
    got = provenance.removals(base, head, "k", "parts", spark.createDataFrame([(8,), (2,), (8,)], "k int"))
    assert sorted(map(tuple, got.collect())) == [(1, "merged", 11), (2, "merged", 11), (3, "destroyed", None), (4, "destroyed", None), (5, "destroyed", None), (6, "merged", 11), (8, "approved", None), (11, "new", None), (12, "new", None), (20, "new", None)]
    assert provenance.removals(base.limit(0), head.limit(0), "k", "parts").count() == 0


def test_items_of_one_name_are_written_out_once_each(monkeypatch):
    """Not once for each pair of them."""
    written, plain = [], trees._plain
    monkeypatch.setattr(trees, "_plain", lambda v: (isinstance(v, dict) and written.append(v), plain(v))[1])
    items = [{"year": 1950, "x": "å", "n": i, "f": -0.0} for i in range(30)]
    assert list(trees.Additivity().lost({"l": items}, {"l": items[::-1]})) == [] and len(written) == 60


def test_objects_are_found_and_shapes_added_up_where_trees_lie(spark):
    """Nothing is shuffled for objects, and only sums for shapes."""
    tree = {"title": "shots", "stats": [3, 4], "in": [{"title": "x", "stats": [1]}, {"deep": {"stats": [5, 6], "title": "corners"}}, {"title": 7, "stats": [1, 2]}], "n": None, "r": 1.5, "q": 2.0}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "{"), (4, "null"), (5, '[{"title": "æ", "stats": []}]'), (6, '"s"')], "k int, tree string")
    walked, wanted = trees.nodes(df, "k", "tree"), [{"title": "text", "stats": "array(2)"}, {"title": "text", "stats": "array"}, {"n": "null", "q": "real"}]
    got = trees.objects(df, "k", "tree", *wanted)
    want = [(*r[:2], nth, list(r[2:])) for nth, w in enumerate(wanted) for r in trees.objects_with(walked, "k", w).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and "Exchange" not in got._jdf.queryExecution().toString()
    plain = walked.groupBy(F.regexp_replace("path", "/[0-9]+", "/*").alias("path"), "type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("value").alias("largest"))
    assert sorted(map(str, trees.shapes(df, "tree").collect())) == sorted(map(str, plain.collect()))
    assert trees.shapes(df.limit(0), "tree").count() == 0 and trees.objects(df.limit(0), "k", "tree", *wanted).count() == 0
