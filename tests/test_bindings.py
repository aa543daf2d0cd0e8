import pytest

from matchledger.functions import bindings

OWN, OTHER = ["Lerka IL", "Lerka"], ["Fjelltun", "Fjelltun FK"]


def found(text, expected=(2, 1)):
    got = bindings.bind(text, OWN, OTHER, expected, places=["Lerka"])
    return got and (got["home"], got["away"], got["turned"], got["agrees"], got["retrospective"], got["non_senior"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Lerka - Fjelltun 2-1 i går.", (2, 1, False, True, False, False)),
        ("Fjelltun – Lerka: 1–2.", (1, 2, True, True, False, False)),
        ("L e r k a - Fjell tun 2-1", (2, 1, False, True, False, False)),
        ("Lerka-Fjelltun 3-0 etter pause", (3, 0, False, False, False, False)),
        ("Lerka slo Fjelltun. Seieren ble 2-1 etter omganger.", (2, 1, False, True, False, False)),
        ("Lerka slo Fjelltun. Været var 2-1.", None),  # another claim
        ("Lerka møtte Fjelltun og vant 2-1, etter 1-1 til pause", (2, 1, False, True, False, False)),
        ("Lerka møtte Fjelltun og vant 3-1, etter 1-1 til pause", None),  # neither is expected
        ("Lerka så på da Viken - Fjelltun 2-1 ble spilt", None),  # the opponent against a third side
        ("Lerka - Fjelltun 2-1. Lerka - Fjelltun 0-0.", None),  # two contests
        ("Lerka - Fjelltun 2-1 mens Viken - Sund 5-0", (2, 1, False, True, False, False)),
        ("I forrige oppgjør vant Lerka over Fjelltun 2-1", (2, 1, False, True, True, False)),
        ("Etter Fjelltun kampen vant Lerka 2-1 mot Fjelltun", (2, 1, False, True, True, False)),
        ("Lerka - Fjelltun 2-1 i juniorkamp", (2, 1, False, True, False, True)),
        ("Lerka - Fjelltun l-O", None),
        ("Lerka - Fjelltun 2-l", (2, 1, False, True, False, False)),
        ("Lerka - Fjelltun 2-31", None),
        ("Kampen i Lerka mot Fjelltun endte 2-1", None),  # a place
        ("Fjelltun vant 2-1", None),
        ("<em>Lerka</em> - Fjelltun 2-1", (2, 1, False, True, False, False)),
        ("", None),
        (None, None),
    ],
)
def test_bound_scores(text, want):
    assert found(text) == want


def test_claims_and_contexts():
    assert bindings.claims("Det var kl. 5. Lerka vant; mens Sund tapte\nSlutt") == ["Det var kl. 5.", "Lerka vant", "mens Sund tapte", "Slutt"]
    text = "Lerka møtte Fjelltun. Kampen mellom Lerka og Fjelltun endte 1-1."
    assert bindings.contexts(text, OWN, OTHER) == [text]
    assert bindings.scores("0-0, l2:3, I—l, 111-2, 3 - 4, 12–31") == [(0, 0), (12, 3), (3, 4)]
    assert bindings.key("Bøn Ålér-FK") == "bøn aaler fk" and not bindings.names_any("Lerkaas vant", OWN)


def test_fragments_read_from_text(spark):
    rows = [("Lerka - Fjelltun 2-1", OWN, OTHER, 2, 1), ("Fjelltun vant", OWN, OTHER, 2, 1), (None, OWN, OTHER, 2, 1), ("Lerka - Fjelltun 2-1", None, OTHER, 2, 1), ("Lerka - Fjelltun 2-1", OWN, OTHER, None, 1), ("Lerka - Fjelltun 2-1 for juniorlag", OWN, OTHER, 2, 1)]
    df = spark.createDataFrame(rows, "t string, own array<string>, other array<string>, h int, a int")
    got = bindings.fragments(df, "t", "own", "other", "h", "a").select("own_found", "opponent_found", "score_matches", "printed.home").collect()
    assert [tuple(r) for r in got] == [(True, True, True, 2), (False, True, None, None), (False, False, None, None), (False, True, None, None), (True, True, False, 2), (True, True, None, None)]
    assert bindings.fragments(df.limit(0), "t", "own", "other", "h", "a").count() == 0


def test_a_repeated_notice_is_read_once(monkeypatch):
    """Reading a notice costs hundreds of times what looking it up costs."""
    read = []
    monkeypatch.setattr(bindings, "_remembered", bindings.lru_cache(maxsize=4)(lambda *x: read.append(x[0]) or bindings._read(*x)))
    long = "Lerka - Fjelltun 2-1" + " og" * bindings.SHORT_TEXT
    columns = [["Lerka - Fjelltun 2-1"] * 50 + [long, None], [OWN] * 52, [OTHER] * 52, [2] * 52, [1] * 52]
    (out,) = bindings._rows([tuple(map(bindings.pd.Series, columns))], ())
    assert read == ["Lerka - Fjelltun 2-1"] and out["home"].tolist()[:51] == [2] * 51 and out["home"].isna().tolist()[51] and out["own_found"].tolist() == [True] * 51 + [False]
