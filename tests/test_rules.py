"""Rules for short texts by example, with nulls and empty texts, and reports on small records."""

from pyspark.sql import functions as F

from matchledger.functions import classify, dates, text
from matchledger.operators import evidence, reports

from .test_functions import values


def test_compared_names(spark):
    given = ["<em>Ånes</em>s  FK", "Brønlia-Éva", "", None]
    assert values(spark, text.compared_name, given) == ["anes s fk", "brønlia eva", "", None]
    assert values(spark, lambda c: text.compared_name(c, rings=True), given)[0] == "aanes s fk"
    assert values(spark, lambda c: text.compared_name(c, markup=False, spaces=False), given[1:]) == ["brønliaeva", "", None]


def test_claims(spark):
    said = "Kl. 18 møttes lagene. Lerka vant; Sund tapte mens Viken hvilte. a.m. Slutt\n\nNy linje"
    assert values(spark, text.claims, [said, "", None]) == [["Kl. 18 møttes lagene.", "Lerka vant", "Sund tapte", "Viken hvilte. a.m.", "Slutt", "Ny linje"], [], None]


def test_parsed_search(spark):
    got = values(spark, text.parsed_search, ["  Fjøl 1952 1952 1899 99999 ", "", "a b c d e f g 1914", None])
    assert [(r["years"], r["terms"]) for r in got] == [([1952], ["fjøl", "1899", "99999"]), ([], []), ([1914], list("abcdef")), (None, None)]


def test_repairs(spark):
    rows = spark.createDataFrame([("S�ther", "Sæther"), ("S�ther", "Sather"), ("Sather", "Sather"), (None, "x"), ("�", None)], "b string, h string")
    assert [r[0] for r in rows.select(text.is_encoding_repair(F.col("b"), F.col("h"))).collect()] == [True, False, False, False, False]


def test_local_time(spark):
    rows = spark.sql("SELECT explode(array(timestamp_ntz'2024-07-01 22:30:00', timestamp_ntz'2024-01-01 22:30:00', null)) AS t").select(dates.local_time(F.col("t")).alias("l")).collect()
    assert [(str(r["l"]["date"]), r["l"]["time"]) for r in rows] == [("2024-07-02", "00:30"), ("2024-01-01", "23:30"), ("None", None)]


def test_hints(spark):
    got = values(spark, classify.note_hints, ["Omkamp i 2. divisjon, borte (e.o.)", "Sunnmørscupen", None])
    assert [(r["competition"], r["side"], r["replay"], r["extra_time"], r["keywords"]) for r in got] == [
        ("2. divisjon", "away", True, True, ["divisjon", "serien", "seriekamp", "omkamp", "ekstraomganger"]), ("sunnmørscupen", None, False, False, ["sunnmørscupen", "kretscup"]), (None, None, False, False, []),
    ]
    assert values(spark, lambda c: classify.side_hint(c, F.lit("Lerka*")), ["på Nørve", "i Oslo", "", None]) == ["home", "away", "away", "away"]
    assert values(spark, lambda c: classify.competition_hint(c, F.lit(1970)), ["1. divisjon", "2.div", "NM", "kretsserie", None]) == ["eliteserien", "forstedivisjon", "nm", None, None]
    assert values(spark, classify.outcome, ["Relegation play-off", "RELEGATED", "European place", None]) == ["relegation_playoff", "relegated", "none", "none"]


def test_pages(spark):
    rows = "\n".join(f"Club {i}  22 10 5 7 40-30 25" for i in range(5))
    assert [values(spark, lambda c, n=n: classify.page_kind(c, F.lit(n)), [rows, "no table"]) for n in (0, 3, 6)] == [["tables_only", "unknown"], ["tables_only", "mixed"], ["mixed", "match_list"]]
    got = values(spark, lambda c: classify.minute(c, F.lit(None).cast("int")), ["45+2", " 90 + 0", "7'", "HT", None])
    assert [r and tuple(r) for r in got] == [(45, 2), (90, None), (7, None), None, None]


def test_access(spark):
    rows = spark.createDataFrame([("ALL", "EVERYWHERE"), ("ALL", None), ("ALL", "LIBRARY"), (None, "EVERYWHERE")], "v string, a string")
    assert [r[0] for r in rows.select(classify.may_store(F.col("v"), F.col("a"))).collect()] == [True, True, False, False]
    line = classify.attribution(F.lit("Avis"), F.lit("19520417"), F.lit("ccby"), "NB")
    assert spark.range(1).select(line).first()[0] == "Avis 17.04.1952, NB (CC BY)"


def test_suspicious_names(spark):
    assert values(spark, reports.suspicious_name, ["R. Eck Olsen", "Leif A", "Ola [x]", "OLA Moe", "HANS Moe"]) == [False, True, True, False, True]


def test_fragments(spark):
    schema = "kind string, opponent_found boolean, own_found boolean, match_talk boolean, score_matches boolean, competition_agrees boolean, side_agrees boolean, temporal string"
    rows = [("article", True, True, True, True, True, True, "high"), ("coupon", True, False, False, True, None, None, "high"), ("unknown", False, False, False, None, False, False, None), ("article", True, True, False, False, False, False, None)]
    assert [r["evidence_score"] for r in evidence.fragment_score(spark.createDataFrame(rows, schema)).collect()] == [112, -12, 0, 40]


def test_reports_on_nothing(spark):
    roles = spark.createDataFrame([], "person int, title string, from_year int, to_year int")
    matches = spark.createDataFrame([], "season int, coach string")
    assert reports.less_precise(roles).count() == reports.outside_spell(roles, roles).count() == 0
    assert reports.other_coaches(spark.createDataFrame([("a", 1990)], "person string, year int"), matches).count() == 0


def test_shootouts(spark):
    matches = spark.createDataFrame([(1, [4, 3], None), (2, [4], [5, 6]), (3, None, [5, 6]), (4, None, None), (5, [None, 2], None)], "match_id int, summary array<int>, header array<int>")
    shots = spark.createDataFrame([(2, True, True), (2, False, False)], "match_id int, is_home boolean, scored boolean")
    assert sorted(map(tuple, reports.shootouts(matches, shots).collect())) == [(1, 4, 3), (2, 1, 0), (3, 5, 6)]
