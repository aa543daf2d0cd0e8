import pytest

from matchledger.operators import offices


def found(*lines, page="", published=None):
    return [(rule, term, name, start, end, body) for rule, term, name, start, end, body, _ in offices.found_in(lines, " ".join(lines), page or "\n".join(lines), published, ours=["lil"])]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["I 1921 ble valgt formann, Øivind Haugen, nestformann, Einar Helle."], [("role_then_name", "nestformann", "Einar Helle", "1921", None, None), ("role_then_name", "formann", "Øivind Haugen", "1921", None, None)]),
        (["Laget med Georg Haller som dens første formann"], [("name_then_role", "formann", "Georg Haller", None, None, None)]),
        (["Nils Jordet ble valgt til sekretær i 1915"], [("name_then_role", "sekretær", "Nils Jordet", "1915", None, None)]),
        (["Georg Haller var formann i banekomiteen"], []),  # an office elsewhere
        (["FRAM-trener Per Hansen"], []),
        (["LIL-trener Per Hansen"], [("role_then_name", "trener", "Per Hansen", None, None, None)]),
        (["Formenn", "1917 Nils Jordet", "1918—19 Georg Haller", "1961 Tor Aarø/Reidar Steen Jensen"], [("year_row", "formann", "Nils Jordet", "1917", None, None), ("year_row", "formann", "Georg Haller", "1918", "1919", None), ("year_row", "formann", "Tor Aarø", "1961", None, None), ("year_row", "formann", "Reidar Steen Jensen", "1961", None, None)]),
        (["1917 Nils Jordet"], []),  # no heading
        (["Banekomiteen hadde Formann: Emil Sando"], [("role_then_name", "formann", "Emil Sando", None, None, "Banekomiteen")]),
        (["Hovedstyret: Formann Emil Sando"], [("role_then_name", "formann", "Emil Sando", None, None, None)]),
        (["Formann ROLF NORDMANN"], []),
        (["Trener S Telefon 1117"], []),
    ],
)
def test_rules(lines, want):
    got = found(*lines)
    assert [g for g in got if g[0] != "name_then_year"] == want


def test_lists_behind_headings():
    text = "Formenn: Sverre Mogen 1925 og 1926 Rolf Mittet 1927 Opmenn: Georg Haller 1914 Ole By 2031"
    got = [g[1:5] for g in found(text, published=1950) if g[0] == "name_then_year"]
    assert got == [("oppmann", "Georg Haller", "1914", None), ("formann", "Sverre Mogen", "1925", "1926"), ("formann", "Rolf Mittet", "1927", None)]


def test_offices_of_pages(spark):
    pages = [
        (1, 1950, 0, ["I 1921 ble valgt formann, Ola Berg, kas-", "serer, Kari Bø."]), (1, 1950, 1, ["Formenn", "1921 Ola Berg", None]),
        (2, None, 0, ["Eldres gruppe og Arbeidsutvalget møttes."]), (2, None, 1, ["I 1930: Formann Ola Berg"]), (3, 1950, 0, None), (3, 1950, 1, []), (4, 1900, 0, ["I 1921 ble valgt formann, Ola Berg"]),
    ]
    df = spark.createDataFrame(pages, "page int, year int, col int, lines array<string>")
    people = spark.createDataFrame([("p1", "OLA BERG"), ("p1", "Ola  Berg"), (None, None)], "person string, name string")
    got = offices.offices(df, ["page", "year"], "col", "lines", people, published="year")
    rows = {(r["page"], r["col"], r["name"], r["person"], r["title"], r["body"], r["from"], r["confidence"], r["rule"]) for r in got.collect()}
    assert rows == {
        (1, 0, "Ola Berg", "p1", "Formann", None, "1921", "high", "role_then_name"), (1, 0, "Kari Bø", None, "Kasserer", None, "1921", "medium", "role_then_name"),
        (1, 1, "Ola Berg", "p1", "Formann", None, "1921", "high", "year_row"), (2, 1, "Ola Berg", "p1", "Formann", None, "1930", "medium", "role_then_name"),
        (4, 0, "Ola Berg", "p1", "Formann", None, None, "medium", "role_then_name"),
    }
    assert offices.offices(df.limit(0), ["page", "year"], "col", "lines", people, "year").count() == 0


def test_only_terms_that_stand_in_a_text_are_looked_for(monkeypatch):
    patterns, colon = offices._patterns()
    asked = set()

    class Asked:
        def __init__(self, term, pattern):
            self.term, self.pattern = term, pattern

        def __getattr__(self, name):
            asked.add(self.term)
            return getattr(self.pattern, name)

    watched = {t: p._replace(**{k: Asked(t, getattr(p, k)) for k in ("before", "behind", "heading")}) for t, p in patterns.items()}
    monkeypatch.setattr(offices, "_patterns", lambda: (watched, colon))
    assert found("i 1995 ble valgt: kasserer, Abdr Rave.") == [("role_then_name", "kasserer", "Abdr Rave", "1995", None, None)]
    assert asked == {"kasserer"}


def test_headings_may_have_a_long_s():
    assert [g[:4] for g in found("ſekretærer Ola Nordberg 1921")] == [("name_then_year", "sekretær", "Ola Nordberg", "1921")]


def test_pages_are_dealt_over_many_tasks(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["printed_offices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan
