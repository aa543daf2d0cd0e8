"""Edge cases of the archive's views and audits: nulls, repeated rows, empty tables, rows that compete."""

from matchledger.operators import archive, reports


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_squad(spark):
    looks = "season int, person_key string, match_id int, name string, role string, day date"
    rows = [(1950, "a", 1, "A", "bench", None), (1950, "a", 1, "Aa", "start", None), (1950, "a", 2, "A", None, None), (1950, None, 1, "?", "start", None), (1951, "b", 3, "B", "bench", None)]
    register = spark.createDataFrame([("a", 7, "back"), ("a", 5, None)], "person_key string, person_id int, position string")
    numbers = spark.createDataFrame([(1950, 5, 9), (1950, 5, 4), (1950, 7, 1)], "season int, person_id int, number int")
    goals = spark.createDataFrame([(1950, "a"), (1950, "a"), (1950, None)], "season int, person_key string")
    out = archive.squad(spark.createDataFrame(rows, looks), goals, register, numbers)
    columns = ("season", "person_key", "name", "appearances", "starts", "person_id", "position", "number", "goals")
    assert got(out, *columns) == [(1950, "a", "A", 2, 1, 5, None, 4, 2), (1951, "b", "B", 1, 0, None, None, None, 0)]
    assert archive.squad(spark.createDataFrame([], looks), goals, register, numbers).count() == 0


def test_home_venues(spark):
    shape = "venue string, periods array<struct<from_year:int,to_year:int>>"
    venues = spark.createDataFrame([("a", [(1950, None)]), ("b", [(1950, 1951), (1951, 1952)]), ("c", []), ("d", None), ("e", [(None, None)])], shape)
    played = spark.createDataFrame([("a", 1949), ("a", 1950), ("a", None), ("b", 1951), ("c", 1950), ("e", 1950)], "venue string, season int")
    assert got(archive.home_venues(venues, played), "venue", "matches", "home_matches") == [("a", 3, 1), ("b", 1, 1), ("e", 1, 0)]


def test_verified_issues(spark):
    shape = "issue int, fragment string, evidence int, same_fragment boolean, phrase string, printed string, retrospective boolean"
    rows = [
        (1, "a", 9, False, None, None, None), (1, "b", 5, True, "today", None, None),
        (2, "a", 9, True, "today", None, None), (2, "b", 5, True, None, "2-1", None),
        (3, "a", 5, True, "today", "2-1", True), (3, "b", 5, True, "then", "0-0", False),
        (4, "a", None, True, "today", "2-1", None),
        (5, "a", 3, None, None, "1-1", None), (5, "b", 2, None, "then", None, None),
    ]
    out = archive.verified_issues(spark.createDataFrame(rows, shape))
    assert got(out, "issue", "fragment", "evidence", "printed", "phrase") == [(1, "a", 9, None, "today"), (2, "b", 5, "2-1", None), (3, "a", 5, "2-1", None), (5, "a", 3, "1-1", None)]


def test_generated_cases(spark):
    rows = [(1, "x", "t", False), (2, "x", "t", True), (3, "x", "t", True), (4, None, "t", True), (5, "y", None, True), (6, "y", None, True), (7, "z", "u", None), (8, "z", "v", True)]
    existing = spark.createDataFrame([("v",), ("v",), (None,)], "target string")
    out = archive.generated_cases(spark.createDataFrame(rows, "row int, candidate string, target string, reviewable boolean"), existing)
    states = ["not_reviewable", "created", "duplicate", "created", "created", "duplicate", "not_reviewable", "manual_case_exists"]
    assert got(out, "row", "state") == list(enumerate(states, 1))


def test_mentions_by_page(spark):
    shape = "person int, source string, page string"
    mentions = spark.createDataFrame([(1, "s", "3"), (1, "s", None), (2, "s", "3"), (None, "s", "3")], shape)
    assert got(archive.uncovered_mentions(mentions, spark.createDataFrame([(1, "s", None)], shape)), "person", "page") == [(1, "3"), (2, "3"), (None, "3")]


def test_moves(spark):
    old = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "coordinate string, payload int")
    new = spark.createDataFrame([("A", 1), ("B", 2), ("D", 4)], "coordinate string, payload int")
    moves = spark.createDataFrame([("a", "A"), ("b", "B"), ("x", "A")], "origin string, target string")
    assert got(archive.moved(old, new, moves), "fault", "about") == [("not_explained", "D"), ("not_moved", "c"), ("origin_unknown", "x"), ("payload_changed", "b"), ("target_twice", "A")]
    assert archive.moved(old.limit(0), new.limit(0), moves.limit(0)).count() == 0


def test_profiles(spark):
    register = spark.createDataFrame([(1, None, "x"), (2, "no", None), (3, None, None)], "person int, country string, position string")
    found = spark.createDataFrame([(1, 2, "se", "y"), (1, 1, None, "x"), (2, 1, "dk", None), (2, 1, "se", "z")], "person int, seen int, country string, position string")
    out = archive.filled_profiles(register, found, "person", ["country", "position"], "seen")
    assert got(out, "person", "country", "position", "conflicts") == [(1, "se", "x", []), (2, "no", "z", ["country"]), (3, None, None, [])]


def test_people_without_anything(spark):
    out = archive.people(
        spark.createDataFrame([(1, "A"), (2, "B")], "person int, name string"),
        spark.createDataFrame([], "person int, season int"),
        spark.createDataFrame([(1, "coach", 1950, None), (1, "coach", 1949, 1951)], "person int, category string, from_year int, to_year int"),
    )
    columns = ("person", "appearances", "role_count", "role_years", "first_role_year", "last_role_year", "role_categories")
    assert got(out, *columns) == [(1, 0, 2, 3, 1949, 1951, ["coach"]), (2, 0, 0, 0, None, None, None)]


def test_doubtful_results(spark):
    kind = "match int, home int, away int, competition_type string, confidence string, providers array<string>"
    rows = [(1, 9, 1, "league", "probable", ["a", "b"]), (2, 8, 1, "league", "confirmed", []), (3, 0, 8, "cup", "confirmed", ["a", "a", None]), (4, 0, 8, "cup", "confirmed", ["a", "b"]), (5, 0, 8, None, "confirmed", None), (6, 0, 9, "cup", "probable", []), (7, None, 9, "league", "confirmed", []), (1, 9, 1, "league", "probable", [])]
    got = reports.doubtful_results(spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, got.collect())) == [(1, 8, "league_margin"), (1, 8, "league_margin"), (3, 8, "confirmed_by_one"), (5, 8, "confirmed_by_one")]
    assert reports.doubtful_results(spark.createDataFrame([], kind)).count() == 0
