import random

import pytest

from matchledger.operators import mentions

PEOPLE = [("p1", "Ola Nordberg"), ("p1", "O. Nordberg"), ("p2", "Kari Ås"), ("p3", "Per van Dal")]


def people(spark):
    return spark.createDataFrame(PEOPLE, "person string, name string")


def test_hits_equal_a_search_for_each_term(spark, monkeypatch):
    r = random.Random(2)
    words = ["ola", "Ola", "nordberg", "åse", "ase", "leder", "daglig", "x1", "-", "é"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))) for i in range(60)] + [(99, None), (98, ""), (1, "daglig leder")]
    terms = [("a", "1", "daglig leder"), ("a", "2", "leder"), ("b", "3", "Åse"), ("b", "3", "ola nordberg"), ("c", None, "ola ola"), ("c", "9", "..."), ("c", "8", None)]
    df, dictionary = spark.createDataFrame(texts, "k int, t string").repartition(3), spark.createDataFrame(terms, "kind string, ref string, form string")
    want = []
    for k, t in texts:
        line = f" {mentions.folded(t or '')} "
        for kind, ref, form in terms:
            needle = f" {mentions.folded(form or '')} "
            at = line.find(needle) if needle.strip() and t else -1
            while at >= 0:
                want.append((k, kind, ref, form, at))
                at = line.find(needle, at + 1)
    for size in (mentions.PART_BYTES, 40):
        monkeypatch.setattr(mentions, "PART_BYTES", size)
        got = [tuple(x) for x in mentions.term_hits(df, ["k"], "t", dictionary).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert mentions.term_hits(df, ["k"], "t", dictionary.limit(0)).count() == 0
    assert mentions.term_hits(df.limit(0), ["k"], "t", dictionary).count() == 0


def test_candidates_of_lines(spark):
    lines = [
        ("s", 1, 0, "Formann Ola Nordberg 1921"), ("s", 1, 1, "Resultat 2-1 mot Sund"), ("s", 1, 2, "Resultat 2-1 mot Sund"),
        ("s", 2, 0, "Terminliste"), ("s", 2, 1, "Sluttabell 1930: poeng 3 : 4"), ("s", 3, 0, None), ("s", 3, 1, "KARI ÅS og Per van Dal"), ("t", 1, 0, "Styreleder ukjent 1880, 3-2"), (None, 1, 0, "Oppmann Ola Nordberg"),
    ]
    df = spark.createDataFrame(lines, "source string, page int, line int, text string")
    got = mentions.candidates(df, ["source", "page"], "line", "text", people(spark), own=mentions.F.col("source") == "s")
    rows = {(r["source"], r["page"], r["kind"], r["confidence"], tuple(r["keywords"]), tuple(r["names"]), tuple(r["years"]), tuple(r["scores"]), tuple(r["people"])) for r in got.collect()}
    assert rows == {
        ("s", 1, "person_mention", "high", (), ("Ola Nordberg",), (1921,), (), ("p1",)),
        ("s", 1, "person_role", "high", ("formann",), ("Ola Nordberg",), (1921,), (), ("p1",)),
        ("s", 1, "match_result", "medium", (), (), (), ("2-1",), ()),
        ("s", 1, "match_result", "medium", (), ("Ola Nordberg",), (1921,), ("2-1",), ()),
        ("s", 1, "match_result", "medium", (), ("Sund Resultat",), (), ("2-1",), ()),
        ("s", 2, "fixture_list", "medium", ("terminliste",), (), (), (), ()),
        ("s", 2, "fixture_list", "medium", ("terminliste",), ("Terminliste Sluttabell",), (1930,), (), ()),
        ("s", 2, "season_fact", "medium", ("poeng", "sluttabell"), (), (1930,), ("3-4",), ()),
        ("s", 2, "match_result", "medium", (), (), (1930,), ("3-4",), ()),
        ("s", 2, "match_result", "medium", (), ("Terminliste Sluttabell",), (1930,), ("3-4",), ()),
        ("s", 3, "person_mention", "medium", (), ("Kari Ås", "Per van Dal"), (), (), ("p2", "p3")),
        (None, 1, "person_mention", "high", (), ("Ola Nordberg",), (), (), ("p1",)),
        (None, 1, "person_role", "medium", ("oppmann",), ("Ola Nordberg",), (), (), ("p1",)),
        ("t", 1, "organization", "medium", ("styreleder",), (), (), (), ()),
    }
    assert got.select("id").distinct().count() == len(rows)
    matches = spark.createDataFrame([("m1", 1930, "c", "3-4"), ("m2", 1930, "c", "4-3"), ("m3", 1930, "d", "3-4")], "match string, season int, opponent string, score string")
    clubs = got.filter("kind = 'match_result'").select("id", mentions.F.lit("c").alias("opponent"))
    assert {(tuple(r["match_ids"]), r["confidence"]) for r in mentions.linked_results(got, clubs, matches).collect()} == {(("m1",), "high")}
    assert mentions.candidates(df.limit(0), ["source", "page"], "line", "text", people(spark)).count() == 0


NAMES = "Ola Nordberg, Kari Ås, Per van Dal, Lars Vik, Nils Aas, Jon Eng, Tor Li, Odd Moe, Arne Bø og Karl Dahl"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"I 1934 møttes de. Seierslaget bestod fra mål til ytre venstre av: {NAMES}. Dommeren var Sverre Lund", None),
        ("Laget bestod av: Ola Nordberg, Kari Ås, Lars Vik, Nils Aas, Jon Eng, Tor Li og Odd Moe. Dommeren Per Hansen", (["Ola Nordberg", "Kari Ås", "Lars Vik", "Nils Aas", "Jon Eng", "Tor Li"], None)),
        ("Troppen var Ola Nordberg, Kari Ås, Lars Vik, Nils Aas, Jon Eng, Tor Li, Odd Moe, Ola Nordberg, A B, Karl Dahl", (["Ola Nordberg", "Kari Ås", "Lars Vik", "Nils Aas", "Jon Eng", "Tor Li", "Odd Moe"], ["p1", "p2"])),
        ("Ola Nordberg, Kari Ås, Lars Vik, Nils Aas, Jon Eng, Tor Li, Odd Moe", None),
        ("", None),
        (None, None),
    ],
)
def test_lineups(spark, text, want):
    got = mentions.lineups(spark.createDataFrame([(1, 1950, text)] * 2, "page int, year int, text string"), ["page", "year"], "text", people(spark), "year").collect()
    if want is None or want[1] is None:
        assert not got or len(got[0]["names"]) >= mentions.LEAST
    else:
        assert [(r["names"], r["people"], r["confidence"], r["season"]) for r in got] == [(*want, "medium", None)]


def test_whole_lineups_and_years(spark):
    text = "Kampen i 1934. Mannskapet var Ola Nordberg, Kari Ås, Per Dal, Lars Vik, Nils Aas, Jon Eng, Tor Li, Odd Moe, Arne Bø, Ola Lie, Karl Dahl"
    register = spark.createDataFrame([(i, n) for i, n in enumerate(["OLA NORDBERG", "Kari As", "Per Dal", "Lars Vik", "Nils Aas", "Jon Eng", "Jon Eng"])], "person int, name string")
    rows = spark.createDataFrame([(1, 1950, text), (2, 1930, text), (3, None, text)], "page int, year int, text string")
    got = mentions.lineups(rows, ["page", "year"], "text", register, "year").orderBy("page").collect()
    assert [(r["season"], len(r["names"]), r["people"], r["confidence"]) for r in got] == [(s, 11, [0, 1, 2, 3, 4, 5], "high") for s in (1934, None, 1934)]


def test_candidates_take_two_shuffles_and_are_the_same_with_many_automata(spark, monkeypatch):
    lines = [(p, i, f"{w} {n}") for p in range(20) for i, (w, n) in enumerate(zip(["Formann", "Terminliste", "2-1 i 1950", "Sluttabell 1951"], ["Ola Nordberg", "Kari Ås", "O. Nordberg", "Per van Dal"], strict=True))]
    df = spark.createDataFrame(lines, "page int, line int, text string")
    got = []
    for size in (mentions.PART_BYTES, 60):
        monkeypatch.setattr(mentions, "PART_BYTES", size)
        found = mentions.candidates(df, ["page"], "line", "text", people(spark))
        got.append(sorted(map(repr, found.collect())))
        if size > 60:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            plan = mentions.candidates(df, ["page"], "line", "text", people(spark))._jdf.queryExecution().executedPlan().toString()
            spark.conf.unset("spark.sql.adaptive.enabled")
            assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert got[0] == got[1] and len(got[0]) > 100


def test_plain_texts_fold_as_any_text():
    r = random.Random(9)
    for _ in range(500):
        text = "".join(map(chr, (r.choice((r.randrange(128), r.randrange(48, 123))) for _ in range(r.randrange(30)))))
        want = mentions.folded(f"{text} é")  # not ASCII, so by Unicode's tables
        assert mentions.folded(text) == want.removesuffix("e").strip()


def test_an_automaton_is_built_once_for_the_tasks_of_a_worker(monkeypatch):
    class Part:
        value = [("role", "leder", "leder")]

    built = []
    monkeypatch.setattr(mentions, "_automaton", lambda entries: built.append(entries))
    part = Part()
    assert mentions._machine(part) is mentions._machine(part) and built == [Part.value]


def test_long_and_repeated_texts_are_read_alike(spark, monkeypatch):
    text = "Formann Ola Nordberg 1921 2-1"
    lines = [(p, i, t) for p in range(3) for i, t in enumerate([text, None, "", text + " x" * 200, text])]
    df = spark.createDataFrame(lines, "page int, line int, text string")
    got = []
    for short in (mentions.SHORT, 0):
        monkeypatch.setattr(mentions, "SHORT", short)
        got.append(sorted(map(repr, mentions.candidates(df, ["page"], "line", "text", people(spark)).collect())))
    assert got[0] == got[1] and len(got[0]) >= 9


def test_candidates_are_told_apart_without_sorting_and_read_in_many_tasks(spark):
    df = spark.createDataFrame([(1, 0, "Formann Ola Nordberg 1921")], "page int, line int, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = mentions.candidates(df, ["page"], "line", "text", people(spark))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortAggregate" not in plan and f", {mentions.PARTS}), REPARTITION_BY_NUM" in plan
