"""Which printed score belongs to a pair of names: a score counts for the pair only where the text binds it to both.

A text is cut into claims. A score that stands right behind both names, with nothing but marks between, is bound outright. Else a claim that names both
sides binds the scores in it, with a short continuation behind it ("The win came at 2-0") as part of the claim; a claim that prints a score of one of the two
against someone else binds none. Two bindings in one text may be two contests, so only a single one counts, and of several scores in it only the expected one.

``bound_score`` is a column function: null where nothing is bound, and for null texts or without names. Long texts are read whole; what a text costs grows
with its length times its names. A task remembers what it read in the last ``REMEMBERED`` short texts, so that a notice which is printed often is read once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A printed score with letters that a scan mistakes for digits, and the largest number of goals that is read as one.
SCORE = r"[\dOoIl]{1,2} ?[-–—−:] ?[\dOoIl]{1,2}"
LOOSE_SCORE = r"[\dOoIl]{1,2}\s*[-–—−:]\s*[\dOoIl]{1,2}"
LARGEST = 30
#: How many texts a task remembers, and up to which length.
REMEMBERED, SHORT_TEXT = 1 << 15, 500
#: Words after which a claim looks back at another contest.
RETROSPECTIVE = (
    r"\b(?:første|forrige|tidligere)\s+(?:møte|oppgjør|kamp)(?:en|et)?\b",
    r"\bi\s+det\s+første\s+møtet\b",
    r"\bi\s+forrige\s+oppgjør\b",
    r"\bforrige\s+gang\b",
    r"\bsist\s+(?:laga|lagene|de)\s+(?:spilte\s+mot\s+hverandre|møttes)\b",
    r"\bsist\s+møttes\b",
    r"\bden\s+gang\b",
    r"\bi\s+(?:vår|høst)kampen\b",
    r"\btidligere\s+i\s+(?:år|sesongen)\b",
    r"\bi\s+cupen\s+tidligere\b",
)
#: Teams that are not the first one; how a continuation of the claim before it begins; abbreviations whose point ends nothing; what parts claims;
#: and the words before a place.
NON_SENIOR = r"\b(?:reserve(?:lags)?(?:kamp|match)?|b\s*[-–—]?\s*lag(?:s(?:kamp|match))?|junior(?:lag|kamp|match)?|lilleputt(?:lag|kamp|match|er)?|guttelag(?:skamp)?|gutte(?:lag|kamp))\b"
CONTINUED = (
    r"^\s*(?:seieren|seiren|tapet|kampen|oppgjøret|resultatet|sluttresultatet|stillingen)\b",
    r"^\s*(?:sist\b|den\s+gang\b|forrige\s+gang\b|i\s+(?:det\s+første\s+møtet|forrige\s+oppgjør|vårkampen|høstkampen|cupen\s+tidligere)\b|tidligere\s+i\s+(?:år|sesongen)\b)",
)
SHORTENED = r"\b(?:dr|st|jr|sr|kl|ca|bl|dvs|feks|mfl|osv|fk|aa|a|f|k)\."
APART = r"[\r\n]+|(?<=[.!?])\s+(?=[A-ZÆØÅ])|;\s+|\s+(?:mens|derimot)\s+|\s+i\s+en\s+annen\s+(?:kamp|notis)\s+"
BEFORE_PLACES = ("i", "på", "fra", "for")

_MARK = "\ue000"
_TEAM = r"\p{L}[\p{L}.]{1,24}(?:\s+\p{L}[\p{L}.]{1,24}){0,2}"
_TAGS = regex.compile(r"</?(?:em|strong|b|i)>", regex.I)
_FOUND = regex.compile(rf"(?<!\d)(?:{SCORE})(?!\d)")
_BACK = regex.compile("|".join(RETROSPECTIVE), regex.I)
_OTHERS = regex.compile(NON_SENIOR, regex.I)
_GOES_ON = regex.compile("|".join(CONTINUED), regex.I)
_SHORT, _APART = regex.compile(SHORTENED, regex.I), regex.compile(APART)
_UNKEYED, _DASH, _LOOSE = regex.compile(r"[^a-z0-9æø]+"), regex.compile("[-–—−:]"), regex.compile(LOOSE_SCORE)
_DIGITS = str.maketrans("OoIl", "0011")


def key(text: str) -> str:
    """Letters and digits of a name or text for comparison, å as aa, other marks left out."""
    plain = (_TAGS.sub(" ", text) if "<" in text else text).lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain.replace("å", "aa")) if not unicodedata.combining(c))
    return _UNKEYED.sub(" ", plain).strip()


_name_key = lru_cache(maxsize=4096)(key)
_PLACE_WORDS = frozenset(map(key, BEFORE_PLACES))


def scores(text: str) -> list[tuple[int, int]]:
    """Printed scores in order. One side at least has a real digit."""
    out = []
    for hit in _FOUND.finditer(text):
        sides = [s.strip() for s in _DASH.split(hit[0])]
        if any(c.isdigit() for s in sides for c in s):
            home, away = (int(s.translate(_DIGITS)) for s in sides)
            if max(home, away) <= LARGEST:
                out.append((home, away))
    return out


def claims(text: str) -> list[str]:
    guarded = _SHORT.sub(lambda m: m[0][:-1] + _MARK, text)
    return [c for c in (part.replace(_MARK, ".").strip() for part in _APART.split(guarded)) if c]


def names_any(text: str, names: Sequence[str], places: Sequence[str] = ()) -> bool:
    """Whether a text names one of them as whole words; a name that is also a place doesn't count behind a word of place."""
    return _named(f" {key(text)} ", names, places)


def _named(words: str, names: Sequence[str], places: Sequence[str] = ()) -> bool:
    for name in map(_name_key, names):
        at = words.find(f" {name} ") if len(name) > 1 else -1
        while at >= 0:
            if name not in map(_name_key, places) or words[:at].rsplit(" ", 1)[-1] not in _PLACE_WORDS:
                return True
            at = words.find(f" {name} ", at + 1)
    return False


@lru_cache(maxsize=4096)
def _loose(name: str) -> str:
    """A pattern of a name whose letters points and spaces may part."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", name) if w]
    return r"\s+".join(r"\s*\.?\s*".join(map(regex.escape, w)) for w in words)


@lru_cache(maxsize=4096)
def _pair(one: str, two: str) -> regex.Pattern:
    return regex.compile(rf"{one}\s*[-–—:]\s*{two}\s*(?:[-–—:]\s*)?({LOOSE_SCORE})([^\r\n.!?;]{{0,160}})", regex.I)


@lru_cache(maxsize=4096)
def _against(b: str) -> tuple[regex.Pattern, regex.Pattern]:
    """A third side and one's score, either way round."""
    return regex.compile(rf"({_TEAM})\s*[-–—:]\s*{b}\s*(?:[-–—:]\s*)?{LOOSE_SCORE}", regex.I), regex.compile(rf"{b}\s*[-–—:]\s*({_TEAM})\s*(?:[-–—:]\s*)?{LOOSE_SCORE}", regex.I)


@lru_cache(maxsize=4096)
def _after(name: str) -> regex.Pattern:
    return regex.compile(rf"\b(?:etter|siden)\s+{regex.escape(name)}\s+kamp(?:en)?\b")


def contexts(text: str, own: Sequence[str], other: Sequence[str], places: Sequence[str] = ()) -> list[str]:
    """Claims that name both sides, each with its continuation; one that another contains stands once."""
    parts, found = claims(text), []
    for i, claim in enumerate(parts):
        words = f" {key(claim)} "
        if _named(words, own, places) and _named(words, other):
            goes_on = i + 1 < len(parts) and _GOES_ON.search(parts[i + 1])
            found.append(f"{claim} {parts[i + 1]}" if goes_on else claim)
    found = list(dict.fromkeys(found))
    return [c for c in found if not any(c != d and c in d for d in found)]


def outright(text: str, own: Sequence[str], other: Sequence[str], places: Sequence[str] = ()) -> list[tuple[str, list[tuple[int, int]]]]:
    """(context, scores) where a score stands behind both names. The context is the claim around it if that prints this score alone, else what follows
    up to the next score."""
    clean, found, around = _TAGS.sub(" ", text), {}, None
    for a in filter(None, map(_loose, own)):
        for b in filter(None, map(_loose, other)):
            for pattern in (_pair(a, b), _pair(b, a)):
                for hit in pattern.finditer(clean):
                    score = scores(hit[1])
                    if len(score) == 1:
                        around = contexts(clean, own, other, places) if around is None else around
                        tail = _LOOSE.split(hit[2], maxsplit=1)[0]
                        near = clean[hit.start() : hit.end(1)] + tail
                        wide = next((c for c in around if hit[1] in c and len(set(scores(c))) == 1), near.strip())
                        found[hit.start(), score[0]] = (wide, score)
    return list(found.values())


def against_others(text: str, own: Sequence[str], other: Sequence[str]) -> bool:
    """Whether a score of the opponent against a third side is printed."""
    clean = _TAGS.sub(" ", text)
    for b in filter(None, map(_loose, other)):
        for pattern in _against(b):
            if any(not names_any(hit[1], own) for hit in pattern.finditer(clean)):
                return True
    return False


def looks_back(context: str, other: Sequence[str]) -> bool:
    if _BACK.search(context):
        return True
    words = key(context)
    return any(_after(name).search(words) for name in map(_name_key, other) if len(name) > 1)


def bind(text: str | None, own: Sequence[str], other: Sequence[str], expected: tuple[int, int], places: Sequence[str] = ()) -> dict | None:
    """The score that a text binds to both names, how it stands to the expected one, and its context."""
    if not text or not own or not other:
        return None
    found = outright(text, own, other, places) or [(c, s) for c in contexts(text, own, other, places) if not against_others(c, own, other) and (s := scores(c))]
    if len(found) != 1:
        return None
    context, printed = found[0]
    different = list(dict.fromkeys(printed))
    fitting = [s for s in different if s == expected or s[::-1] == expected]
    score = fitting[0] if len(fitting) == 1 else different[0] if len(different) == 1 else None
    if score is None:
        return None
    turned = score != expected and score[::-1] == expected
    return {"home": score[0], "away": score[1], "turned": turned, "agrees": score == expected or turned, "context": context, "retrospective": looks_back(context, other), "non_senior": bool(_OTHERS.search(context))}


BINDING = "struct<home: int, away: int, turned: boolean, agrees: boolean, context: string, retrospective: boolean, non_senior: boolean>"
_FIELDS = {"home": "Int32", "away": "Int32", "turned": "boolean", "agrees": "boolean", "context": "object", "retrospective": "boolean", "non_senior": "boolean"}


def _read(text: str, own: tuple[str, ...], other: tuple[str, ...], expected: tuple[int, int], places: tuple[str, ...]) -> tuple:
    """What ``bind`` finds, as a row of ``_FIELDS``, and whether the text names either side."""
    found = bind(text, own, other, expected, places) or dict.fromkeys(_FIELDS)
    words = f" {key(text)} "
    return *(found[k] for k in _FIELDS), _named(words, own, places), _named(words, other, places)


_remembered = lru_cache(maxsize=REMEMBERED)(_read)


def _rows(parts: Iterator[tuple[pd.Series, ...]], places: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    columns = {**_FIELDS, "own_found": "bool", "opponent_found": "bool"}
    kept = lambda names: () if names is None else tuple(x for x in names if x)
    for series in parts:
        rows = []
        for t, a, b, h, w in zip(*series, strict=True):
            read = _remembered if t and len(t) <= SHORT_TEXT else _read
            rows.append(read(t or "", kept(a), kept(b), (-1, -1) if pd.isna(h) or pd.isna(w) else (int(h), int(w)), places))
        yield pd.DataFrame(rows, columns=list(columns)).astype(columns)


def _found(text: Column, own: Column, other: Column, home: Column, away: Column, places: Sequence[str]) -> Column:
    """A struct of what ``bind`` says and own_found, opponent_found."""
    schema, held = T.StructType.fromDDL(BINDING[7:-1].replace(":", "") + ", own_found boolean, opponent_found boolean"), tuple(places)

    @F.pandas_udf(schema)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from _rows(parts, held)

    return run(text, own, other, home, away)


def _bound(found: Column) -> Column:
    return F.when(found["home"].isNotNull(), F.struct(*(found[k].alias(k) for k in _FIELDS)))


def bound_score(text: Column, own: Column, other: Column, home: Column, away: Column, places: Sequence[str] = ()) -> Column:
    """``bind`` for every row: own and other are arrays of names; a struct as BINDING says, or null."""
    return _bound(_found(text, own, other, home, away, places))


def fragments(df: DataFrame, text: str, own: str, other: str, home: str, away: str, places: Sequence[str] = ()) -> DataFrame:
    """Adds what ``evidence.fragment_score`` asks for, read from the text: own_found, opponent_found, score_matches (null without a bound score) and
    printed (home and away). A bound score of an earlier contest or of another team counts as none."""
    rows = df.withColumn("_found", _found(F.col(text), F.col(own), F.col(other), F.col(home), F.col(away), places)).withColumn("binding", _bound(F.col("_found")))
    counts = F.col("binding").isNotNull() & ~F.col("binding.retrospective") & ~F.col("binding.non_senior")
    return rows.withColumns({
        "own_found": F.col("_found.own_found"), "opponent_found": F.col("_found.opponent_found"), "score_matches": F.when(counts, F.col("binding.agrees")),
        "printed": F.when(counts, F.struct(F.col("binding.home").alias("home"), F.col("binding.away").alias("away"))),
    }).drop("_found")
