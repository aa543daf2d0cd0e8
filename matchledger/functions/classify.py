"""Classes and hints read from short texts by ordered rules: the first that fits decides. Patterns are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern in a note, the competition it hints at, words to search for. Fixed values.
NOTED = (
    ("\\bcupen\\b|\\bnm\\b|norgesmesterskap", "cup", ("cup", "cupkamp", "cupen", "norgesmesterskapet")),
    ("sunnmørs-?cup", "sunnmørscupen", ("sunnmørscupen", "kretscup")),
    ("sommer-?cup", "sommercupen", ("sommercupen",)),
    ("tippe-?cup", "tippecupen", ("tippecupen",)),
    ("kval\\.?-?kamp|kvalifiser", "kvalifisering", ("kvalifisering", "kvalik", "kvalifiseringskamp")),
    ("landsdelsserie", "landsdelsserien", ("landsdelsserien", "landsdelsseriekampen")),
    ("\\d\\.?\\s?divisjon", "divisjon", ("divisjon", "serien", "seriekamp")),
    ("seriekamp|\\bserien\\b", "serie", ("serien", "seriekamp")),
    ("privatkamp|treningskamp|vennskapskamp", "privatkamp", ("privatkamp", "treningskamp")),
    ("distriktsmesterskap|\\bdm\\b", "distriktsmesterskap", ("distriktsmesterskapet",)),
)
#: What a note says about the side that was played on, home before away. Fixed values.
AT_HOME = ("hjemme", "(h)", "på nørve", "på aksla", "i ålesund")
AWAY = ("borte", "(b)", "i trondheim", "i oslo", "i fosnavåg", "i mo i rana", "på veblungsnes", "på straumgjerde", "på vigra")
#: Codes of licences and their names. Fixed values.
LICENCES = {"ccbyncnd": "CC BY-NC-ND", "ccbync": "CC BY-NC", "ccby": "CC BY", "cc0": "CC0", "publicdomain": "offentlig eiendom", "copyrighted": "opphavsrettsbeskyttet"}


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda x, p: x | F.contains(text, F.lit(p)), parts[1:], F.contains(text, F.lit(parts[0])))


def _first(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    out = reduce(lambda x, r: x.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def side_hint(note: Column, opponent: Column) -> Column:
    """``home`` or ``away`` by a note, else ``away`` where the opponent's name has an asterisk, else null."""
    said = F.coalesce(F.lower(note), F.lit(""))
    return _first([(_any(said, AT_HOME), "home"), (_any(said, AWAY), "away"), (F.contains(opponent, F.lit("*")), "away")])


def note_hints(note: Column) -> Column:
    """A note's hints: competition (a division with its number), side, replay, extra_time, and keywords, each once."""
    said = F.coalesce(F.lower(note), F.lit(""))
    number = F.regexp_extract(said, "(\\d)\\.?\\s?divisjon", 1)
    named = [(said.rlike(p), F.concat(number, F.lit(". divisjon")) if hint == "divisjon" else F.lit(hint), F.array(*map(F.lit, words))) for p, hint, words in NOTED]
    competition = _first([(c, hint) for c, hint, _ in named])
    words = _first([(c, w) for c, _, w in named], F.array().cast("array<string>"))
    replay, extra = said.rlike("\\bomkamp\\b"), said.rlike("ekstraomgang|e\\.\\s?o\\.")
    more = F.array_compact(F.array(F.when(replay, F.lit("omkamp")), F.when(extra, F.lit("ekstraomganger")), F.when(said.rlike("\\bfinale\\b"), F.lit("finale"))))
    side = _first([(said.rlike("\\bbortekamp\\b|\\bborte\\b"), "away"), (said.rlike("\\bhjemmekamp\\b|\\bhjemme\\b"), "home")])
    return F.struct(competition.alias("competition"), side.alias("side"), replay.alias("replay"), extra.alias("extra_time"), F.array_distinct(F.concat(words, more)).alias("keywords"))


def competition_hint(note: Column, season: Column) -> Column:
    """The competition that a note names; a division's level depends on the season's year."""
    said = F.lower(note)
    second = _any(said, ("2. div", "2.div"))
    first = _any(said, ("1. div", "1.div", "landsdelsserie"))
    return _first(
        [
            (_any(said, ("nm", "n.m.", "norgesmesterskap", "cup")), "nm"),
            (_any(said, ("jubileum", "pokal", "privat", "treningskamp")), "treningskamp"),
            (_any(said, ("3. div", "3.div")), "andredivisjon"),
            (second & (season < 1963), "andredivisjon"),
            (second, "forstedivisjon"),
            (first & season.between(1963, 1990), "eliteserien"),
            (first, "forstedivisjon"),
        ]
    )


def competition_class(known: Column, name: Column) -> Column:
    """The class that is known for a competition's id, else one by its name."""
    said = F.lower(name)
    by_name = _first(
        [(said.rlike("europa|champions|conference"), "europe"), (said.rlike("friendly|treningskamp"), "friendly"), (said.rlike("cup|nm"), "cup"), (said.rlike("division|eliteserien|tippeliga|league"), "league")],
        F.lit("other"),
    )
    return F.coalesce(known, by_name)


def outcome(status: Column) -> Column:
    """What a table's remark means for the side on that row."""
    said = F.lower(F.coalesce(status, F.lit("")))
    return _first(
        [(said.rlike("relegation play-?off"), "relegation_playoff"), (said.rlike("promotion play-?off"), "promotion_playoff"), (said.rlike("relegated"), "relegated"), (said.rlike("promoted"), "promoted"), (said.rlike("^play-?off"), "playoff")],
        F.lit("none"),
    )


def label_kind(label: Column) -> Column:
    """What a link's label says of the page behind it."""
    said = F.lower(F.coalesce(label, F.lit("")))
    return _first([(said.rlike("tables?\\s*only|kun tabell"), "tables_only"), (said.rlike("round by round|runde for runde"), "match_list")], F.lit("unknown"))


def page_kind(text: Column, matches: Column, least: int = 5) -> Column:
    """What a page holds, by its table rows (a name, five numbers with a pair of goals among them) and its matches."""
    rows = F.regexp_count(text, F.lit("(?m)^[ \\t]*\\S[^\\n]*?[ \\t]+\\d+[ \\t]+\\d+[ \\t]+\\d+[ \\t]+\\d+[ \\t]+\\d+-\\d+[ \\t]+\\d+"))
    table = F.coalesce(rows >= least, F.lit(False))
    return F.when(table & (matches >= least), "mixed").when(table, "tables_only").when(matches >= least, "match_list").when(matches > 0, "mixed").otherwise("unknown")


def minute(said: Column, overload: Column) -> Column:
    """A printed time such as 45+2: its minute and stoppage (null if none); null where no minute is printed. ``overload`` is
    stoppage given apart."""
    main = F.regexp_extract(said, "^\\s*(\\d{1,3})", 1)
    added = F.regexp_extract(said, "^\\s*\\d{1,3}\\s*\\+\\s*(\\d{1,2})", 1)
    extra = F.when(added != "", added.try_cast("int")).otherwise(overload)
    return F.when(main != "", F.struct(main.try_cast("int").alias("minute"), F.when(extra > 0, extra).alias("stoppage")))


def may_store(viewability: Column, allowed_from: Column) -> Column:
    """Whether a full text may be kept: only if it is open to all everywhere. What isn't known is no."""
    return F.coalesce(viewability == "ALL", F.lit(False)) & F.coalesce(allowed_from == "EVERYWHERE", F.lit(True))


def attribution(paper: Column, issued: Column, licence: Column, holder: str) -> Column:
    """The line that credits a paper: name, date, holder, and the licence where there is one."""
    day = F.when(issued.rlike("^\\d{8}$"), F.concat_ws(".", F.substring(issued, 7, 2), F.substring(issued, 5, 2), F.substring(issued, 1, 4))).otherwise(F.coalesce(issued, F.lit("ukjent dato")))
    names = F.create_map(*(F.lit(x) for pair in LICENCES.items() for x in pair))
    label = F.coalesce(F.try_element_at(names, F.lower(licence)), licence)
    return F.concat(paper, F.lit(" "), day, F.lit(", " + holder), F.when(licence != "", F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(""))
