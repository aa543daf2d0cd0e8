"""Normalisers and dates by example, the assignment by enumeration, and the gate for free SQL."""

import datetime
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from matchledger.functions import dates, text
from matchledger.operators import evidence, identity
from matchledger.plans import gate


def values(spark, make, given):
    rows = spark.createDataFrame(list(enumerate(given)), "k int, v string").select("k", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["k"])]


def test_person_keys(spark):
    names = {"Bjørdal": "bjordal", "Bjoerdal": "bjordal", "Þrándarson": "thrandarson", "Međimorec": "medimorec", "Åse Aas": "ase as", "Müller-Mueller": "muller muller", "Sæther": "sather", " José  María ": "jose maria"}
    assert values(spark, text.person_key, [*names, None]) == [*names.values(), None]


def test_organisation_keys(spark):
    slugs = {"fk-haugesund": "haugesund", "haugesund-fk": "haugesund", "spjelkavik-il-fotball": "spjelkavik", "vard-haugesund": "vard-haugesund", "il": "il", "il-fk": "fk", "fk-il-sk": "il", "fotballklubben-vard": "vard", "skarp": "skarp"}
    assert values(spark, text.organisation_key, list(slugs)) == list(slugs.values())
    assert values(spark, text.slug, ["Brønnøysund IL", "Ærlig & Åpen", None]) == ["bronnoysund-il", "aerlig-apen", None]


def test_relative_dates(spark):
    issue = datetime.date(1994, 5, 11)  # a Wednesday
    said = {
        "Kampen i går kveld": (-1, "high"), "de spilte igår": (-1, "high"), "ute i gården": None, "morgendagens motstander": (1, "high"),
        "kveldens kamp": (0, "high"), "spilles i kveld": (0, "medium"), "I DAG": (0, "medium"), "i forgårs": None,
    }
    got = values(spark, lambda c: dates.relative_date(c, F.lit(issue)), list(said))
    for (phrase, want), r in zip(said.items(), got, strict=True):
        assert (r is None) if want is None else ((r["date"] - issue).days, r["confidence"]) == want, phrase


def test_assignment_is_exact():
    r = random.Random(6)
    for _ in range(40):
        edges = [(f"h{i}", f"e{j}", float(r.randrange(-20, 60))) for i in range(r.randrange(1, 5)) for j in range(r.randrange(1, 6)) if r.random() < 0.8] or [("h0", "e0", 1.0)]
        score = {(h, e): s for h, e, s in edges}
        people, events = sorted({h for h, _ in score}), sorted({e for _, e in score})
        best = max(sum(score[p] for p in zip(people, order, strict=True) if p[1]) for order in set(permutations([*events, *[None] * len(people)], len(people))) if all(e is None or (h, e) in score for h, e in zip(people, order, strict=True)))
        got = evidence.assign(score)
        events = [e for _, e, _, _ in got if e]
        assert sum(s or 0 for _, _, s, _ in got) == best and len(set(events)) == len(events) and [h for h, _, _, _ in got] == people


def test_gate(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("version"), "id").write.parquet(f"{tmp_path}/v")
    spark.range(3).createOrReplaceGlobalTempView("hidden")
    own = gate.guest(spark, {"published": f"{tmp_path}/v"})
    assert len(gate.run(own, "SELECT version, id AS range FROM published WHERE id > 1", seconds=60).rows) == 3
    assert gate.run(own, "WITH a AS (SELECT id FROM published) SELECT count(*) AS n FROM a WHERE id IN (SELECT id FROM published)", seconds=60).rows == [{"n": 5}]
    assert gate.run(own, "SELECT * FROM published", rows=2, seconds=60).truncated
    spark.sql(f"CREATE TABLE saved_secret USING parquet LOCATION '{tmp_path}/v'")
    try:
        for bad in (
            "SELECT * FROM global_temp.hidden", "SELECT * FROM saved_secret", "SELECT * FROM default.saved_secret", f"SELECT * FROM parquet.`{tmp_path}/v`",
            "SELECT id FROM published WHERE id IN (SELECT id FROM saved_secret)", "WITH a AS (SELECT * FROM saved_secret) SELECT 1 AS x FROM a", "SELECT (SELECT max(id) FROM global_temp.hidden) AS m FROM published",
            "DROP TABLE saved_secret", "SELECT 1; SELECT 2", "", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM range(3)", "SELECT 1 /* " + "x" * 4000 + " */", "SELECT nothing FROM published", "SHOW TABLES",
        ):
            with pytest.raises(gate.Rejected):
                gate.run(own, bad, seconds=60)
    finally:
        spark.sql("DROP TABLE saved_secret")


def test_near_names_of_all_lengths(spark):
    r = random.Random(9)
    names = ["", "a", "ab", "ba", "Customer#0001", "Customer#0010", "Customer#0002"]
    for n in (3, 12, 38, 39, 40, 41, 42, 60):
        for _ in range(4):
            name = "".join(r.choice("abcd") for _ in range(n))
            names.append(name)
            for _ in range(3):
                k = r.randrange(len(name) + 1)
                name = r.choice([name[:k] + "x" + name[k:], name[:k] + name[k + 1 :], name[:k] + "y" + name[k + 1 :]])
                names.append(name)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for most in (1, 2):
        got = {tuple(x) for x in identity.near_names(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "name", most).collect()}
        assert got == {(a, b, edits(a, b)) for a in set(names) for b in set(names) if a < b and edits(a, b) <= most}
