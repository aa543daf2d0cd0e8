"""Who held which office, read from the columns of a page by four rules: a title before a name, a name before a title, rows of a year and a name under a heading,
and names with their years behind one.

Years come from a row itself, from right behind the title, or from close before it, and never from after the publication. A title belongs to the body that
is named last before it, else to the only body that the page names; where the page names several, nothing sure is said. Of what several rules find of one name, title and
year the surest stays. Names are held against a register by their folded form.

Null and empty columns say nothing; an empty table gives no rows. A page's text is joined for the bodies it names, so keep pages of the size of pages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mentions import folded

#: Terms of offices with their titles and categories.
OFFICES = {
    "sportslig leder": ("Sportslig leder", "sporting_staff"),
    "daglig leder": ("Daglig leder", "administration"),
    "administrerende direktør": ("Administrerende direktør", "administration"),
    "nestformann": ("Nestformann", "board"),
    "styremedlem": ("Styremedlem", "board"),
    "varamedlem": ("Varamedlem", "board"),
    "æresmedlem": ("Æresmedlem", "honorary"),
    "gullmerke": ("Gullmerkeinnehaver", "honorary"),
    "styreleder": ("Styreleder", "board"),
    "hovedtrener": ("Hovedtrener", "coach"),
    "materialforvalter": ("Materialforvalter", "sporting_staff"),
    "sekretær": ("Sekretær", "administration"),
    "kasserer": ("Kasserer", "administration"),
    "oppmann": ("Oppmann", "sporting_staff"),
    "direktør": ("Direktør", "administration"),
    "formann": ("Formann", "board"),
    "trener": ("Trener", "coach"),
}
#: Irregular plurals of headings, bodies, the one that is the whole, words that are no names, and how far things may stand apart.
PLURALS = {"formann": ("formenn", "formennene"), "nestformann": ("nestformenn", "nestformennene"), "oppmann": ("oppmenn", "oppmennene", "opmenn", "opmennene", "opmann")}
ENDINGS = "(?:ene|er|ne|e|mer|mene)?"
BODIES = ("hovedstyret", "arbeidsutvalget", "sportsutvalget", "banekomiteen", "eldres gruppe", "juniorgruppa", "juniorgruppen", "damegruppa", "damegruppen", "supporterklubben", "old boys")
BODY = r"\b(\p{L}+(?:komiteen|komitéen|utvalget|gruppa|gruppen))\b"
MAIN = "hovedstyret"
NO_NAMES = (
    "klubben", "klubbens", "styret", "styrets", "stiftelsen", "hovedstyret", "arbeidsutvalget", "laget", "lagets", "norges", "fotballforbund", "fotballklub", "fotballklubb",
    "fotballklubben", "medlemsblad", "hvilken", "hvem", "den", "det", "denne", "dette", "der", "her", "han", "hun", "som", "ble", "var", "har", "til", "for", "med", "og", "gruppe", "gruppen",
    "komité", "komiteen", "møtet", "årsmøtet", "sesongen", "kretsen", "as", "fotball", "avdeling", "telefon", "telefonnr", "adresse", "postboks", "konto", "bankgiro",
)
PARTICLES = "van|von|de|da|di|le|la"
YEAR_BEFORE, BODY_BEFORE, LIST_REACH, PREFIX = 160, 400, 1600, 40
#: How much surer one rule is than another.
RULES = {"year_row": 3, "role_then_name": 2, "name_then_role": 1, "name_then_year": 1}

_TOKEN = r"[A-ZÆØÅÀ-Þ][\p{L}'’.-]*"
_NAME = rf"{_TOKEN}(?:\s+(?:{PARTICLES})\s+|\s+)?(?:{_TOKEN}(?:\s+{_TOKEN})?(?:\s+{_TOKEN})?)"
_YEAR = r"(?:18\d{2}|19\d{2}|20\d{2})"
_NEAR_YEAR = regex.compile(r"\b(?:18[5-9]\d|19\d{2}|20\d{2})\b")
_NEXT_YEAR = regex.compile(r"\s*(?:i|fra|siden)?\s*(1[89]\d{2}|20\d{2})\b")
_ROW = regex.compile(rf"^({_YEAR})(?:\s*[-–—]\s*(\d{{2,4}}))?[\s.:]*({_NAME}(?:\s*/\s*{_NAME})*)$")
_ENTRY = regex.compile(rf"({_NAME})[\s.]*({_YEAR}(?:\s*(?:og|,|–|—|-)\s*{_YEAR})*)")
_BODY = regex.compile(BODY, regex.I)
_NOT = frozenset(map(folded, NO_NAMES))
_STOPS, _SPACES, _CAPITAL, _PARTICLE = regex.compile(r"[.,;:]+$"), regex.compile(r"\s+"), regex.compile("[A-ZÆØÅÀ-Þ]"), regex.compile(PARTICLES, regex.I)
_JOINED, _INSIDE, _ELSEWHERE, _DIGITS = regex.compile(r"([\p{L}.]+)-$"), regex.compile(r"\p{L}$"), regex.compile(r"\s*(?:i|for)\s+(?!\d)"), regex.compile(r"\d{4}")
#: The last of the years in reach, read from the end.
_LAST_YEAR = regex.compile(r"(?r)\b(?:18[5-9]\d|19\d{2}|20\d{2})\b")
#: What every match of a rule holds; a text without it is not read by that rule.
_VERBED, _DATED, _BODY_ENDS = regex.compile(rf"{_TOKEN}\s+(?:som|ble|var)\b"), regex.compile(rf"{_TOKEN}[\s.]*{_YEAR}"), ("komiteen", "komitéen", "utvalget", "gruppa", "gruppen")


class _Office(NamedTuple):
    """How a term is written: what every form of it holds, before a name, behind a name, as a heading anywhere."""

    stems: tuple[str, ...]
    before: regex.Pattern
    behind: regex.Pattern
    heading: regex.Pattern


@lru_cache(maxsize=1)
def _patterns() -> tuple[dict[str, _Office], regex.Pattern]:
    """The patterns of each term, and that of any term as a heading with a colon."""
    out, all_forms = {}, []
    for term in OFFICES:
        word = "".join(f"[{c.upper()}{c}]" if c != c.upper() else regex.escape(c) for c in term)
        forms = "|".join([term + ENDINGS, *PLURALS.get(term, ())])
        all_forms.append(forms)
        out[term] = _Office(
            (term, *PLURALS.get(term, ())), regex.compile(rf"\b{word}\b[\s,:.]+({_NAME})"),
            regex.compile(rf"({_NAME})\s+(?:som|ble|var)\b[^.;]{{0,40}}?\b{word}\b"), regex.compile(rf"\b(?:{forms})\b", regex.I),
        )
    return out, regex.compile(rf"\b(?:{'|'.join(all_forms)})\s*:", regex.I)


def _low(text: str) -> str:
    """Small letters, with those that patterns take for an i and an s."""
    return text.replace("İ", "i").replace("ſ", "s").lower()


@lru_cache(maxsize=1 << 16)
def clean_name(raw: str) -> str | None:
    """A name of two to four words, or null for what only looks like one."""
    name = _STOPS.sub("", _SPACES.sub(" ", raw).strip())
    words, low = name.split(" "), name.lower()
    if not 2 <= len(words) <= 4 or any(folded(w) in _NOT for w in words) or any(term in low for term in OFFICES):
        return None
    shouted = any(len(w) > 3 and w == w.upper() for w in words)
    stray = any(len(w) < 2 and not w.endswith(".") for w in words)
    small = any(len(w) > 2 and not _CAPITAL.match(w) and not _PARTICLE.fullmatch(w) for w in words)
    return None if shouted or stray or small else name


def _others(text: str, at: int, ours: Sequence[str]) -> bool:
    """Whether a title is joined to another club's name, or stands inside a word."""
    before = text[max(0, at - PREFIX) : at]
    joined = _JOINED.search(before) if "-" in before[-2:] else None
    return joined[1].lower().replace(".", "") not in ours if joined else bool(_INSIDE.search(before[-2:]))


def _some_body(text: str) -> bool:
    """Whether a text may name a body."""
    low, plain = text.lower(), _low(text)
    return any(b in low for b in BODIES) or any(b in plain for b in _BODY_ENDS)


def _bodies(page: str) -> list[str]:
    """The bodies that a page names, the whole left out, as well as those that are part of another one's name."""
    if not _some_body(page):
        return []
    low = page.lower()
    found = {b for b in BODIES if b in low} | {m[1].lower() for m in _BODY.finditer(page)}
    found.discard(MAIN)
    return [b for b in found if not any(b != c and b in c for c in found)]


def _body(text: str, at: int, on_page: list[str]) -> tuple[str | None, bool]:
    """(body, whether it can't be told) of a title."""
    before = text[max(0, at - BODY_BEFORE) : at]
    low = before.lower()
    places = [(low.rfind(b), 1, b) for b in BODIES if b in low] + [(m.start(), 0, m[1]) for m in _BODY.finditer(before)]
    chosen = max(places)[2] if places else on_page[0] if len(on_page) == 1 else None
    if chosen is None:
        return None, len(on_page) > 1
    name = chosen.lower().replace("é", "e")
    return (None, False) if name == MAIN else (name[:1].upper() + name[1:], False)


def found_in(lines: Sequence[str], text: str, page: str, published: int | None = None, ours: Sequence[str] = ()) -> Iterator[tuple]:
    """(rule, term, name, from, to, body, unclear) in the order of the rules."""
    (patterns, colon), on_page, low = _patterns(), _bodies(page), _low(text)
    # Where a text names no body there is none to look for before a title.
    around = text if _some_body(text) else ""
    late = lambda year: published is not None and int(year) > published
    standing = lambda stems, low: any(s in low for s in stems)

    def year_before(at: int) -> str | None:
        year = _LAST_YEAR.search(text[max(0, at - YEAR_BEFORE) : at])
        return year[0] if year and not late(year[0]) else None

    if rows := [m for m in (_ROW.match(x.strip()) for x in lines) if m]:
        held = [(x, _low(x)) for x in (*lines, page)]
        heading = next((t for t, p in patterns.items() if any(standing(p.stems, y) and p.heading.search(x) for x, y in held)), None)
        for m in rows if heading else ():
            if not late(m[1]):
                to = m[1][:2] + m[2] if m[2] and len(m[2]) == 2 else m[2]
                yield from (("year_row", heading, name, m[1], to, None, False) for name in map(clean_name, m[3].split("/")) if name)
    verbed = bool(_VERBED.search(text))
    for term, p in patterns.items():
        if term not in low:
            continue
        for m in p.before.finditer(text):
            if (name := clean_name(m[1])) and not _others(text, m.start(), ours):
                yield "role_then_name", term, name, year_before(m.start()), None, *_body(around, m.start(), on_page)
        for m in p.behind.finditer(text) if verbed else ():
            rest = text[m.end() :]
            if (name := clean_name(m[1])) and not _others(text, m.end() - len(term), ours) and not _ELSEWHERE.match(rest):
                after = _NEXT_YEAR.match(rest)
                yield "name_then_role", term, name, after[1] if after else year_before(m.start()), None, *_body(around, m.start(), on_page)
    if not _DATED.search(text):
        return
    for term, p in patterns.items():
        for head in p.heading.finditer(text) if standing(p.stems, low) else ():
            ends = [m.start()] if (m := colon.search(text, head.end() + 1)) else []
            for m in _ENTRY.finditer(text[head.end() : min([head.end() + LIST_REACH, *ends])].removeprefix(":")):
                years = _DIGITS.findall(m[2])
                if (name := clean_name(m[1])) and not late(years[0]):
                    yield "name_then_year", term, name, years[0], years[-1] if len(years) > 1 else None, None, False


def offices(columns: DataFrame, on: Sequence[str], column: str, lines: str, people: DataFrame, published: str | None = None, ours: Sequence[str] = ()) -> DataFrame:
    """(on..., column, id, name, person, title, category, body, from, to, confidence, rule). columns: one row a column of a page, with its lines as an array; people: person, name
    (one row a name); ``published``: a column of ``on`` with the publication's year; ours: prefixes that a title may have."""
    names = [*on, column]
    schema = ", ".join(f"`{k}` {columns.schema[k].dataType.simpleString()}" for k in names) + ", nth int, rule string, term string, name string, form string, `from` string, `to` string, body string, unclear boolean"
    text = F.array_join(F.col(lines), " ")
    # A hyphen at a line's end before a small letter parts a word.
    mended = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.col(lines), "\n"), r"-\n(?=\p{Ll})", ""), r"\s+", " "))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), text.alias("t"))).over(Window.partitionBy(*on))), lambda x: x["t"]), "\n")
    rows = columns.filter(F.col(lines).isNotNull()).select(*names, F.array_compact(lines).alias("_lines"), mended.alias("_text"), page.alias("_page"))
    published_at = list(on).index(published) if published else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            texts = (batch.column(len(names) + j).to_pylist() for j in range(3))
            years = batch.column(published_at).to_pylist() if published_at is not None else [None] * batch.num_rows
            for i, (held, said, around, year) in enumerate(zip(*texts, years, strict=True)):
                for nth, (rule, term, name, *rest) in enumerate(found_in(held, said or "", around or "", year, ours)):
                    at.append(i)
                    out.append((nth, rule, term, name, folded(name), *rest))
            cells = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int32(), *[pa.string()] * 7, pa.bool_()]
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(places) for j in range(len(names))), *(pa.array(c, t) for c, t in zip(cells, kinds, strict=True))], [*names, "nth", "rule", "term", "name", "form", "from", "to", "body", "unclear"])

    fold = F.pandas_udf(lambda s: s.map(lambda x: folded(x) if x else None), "string")
    register = people.select("person", fold("name").alias("form")).filter("form <> ''").groupBy("form").agg(F.min("person").alias("person"))
    found = rows.mapInArrow(run, schema).join(register, "form", "left")
    dated, known = F.col("from").isNotNull(), F.col("person").isNotNull()
    sure = F.when(dated & known, F.when(F.col("unclear"), 2).otherwise(3)).when(dated | known, 2).otherwise(1)
    rank = sure * 10 + F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in RULES.items() for x in p)), F.col("rule")), F.lit(0))
    best = F.max_by(F.struct("rule", "name", "person", "to", "body", sure.alias("sure")), F.struct(rank, -F.col("nth"))).alias("b")
    kept = found.groupBy(*names, "form", "term", "from").agg(best)
    said = lambda i: F.create_map(*(F.lit(x) for t, v in OFFICES.items() for x in (t, v[i])))[F.col("term")]
    mark = F.sha2(F.to_json(F.struct(*on, "term", "form", "from", F.col("b.body").alias("body"))), 256)
    confidence = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("b.sure"))
    return kept.select(*names, F.concat(F.lit("office-"), F.substring(mark, 1, 16)).alias("id"), "b.name", "b.person", said(0).alias("title"), said(1).alias("category"), "b.body", "from", "b.to", confidence.alias("confidence"), "b.rule")
