"""What lines of a publication say: typed candidates for facts, and lineups.

Names of people and clubs and the terms of each kind of fact form one dictionary. An Aho-Corasick automaton finds all of them in one pass over a text, however many
there are; a dictionary larger than ``PART_BYTES`` is cut by hash into several automata, each of which goes over the texts, so that no task holds more
than one part at a time. Hits are whole words of the folded text (lower case, marks left out, anything but letters and digits a space).

Null and empty texts have no hits; a term that folds to nothing is never found; repeated lines give their candidates once; an empty table or dictionary gives
no rows of its kind. A text is read whole, whatever its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import PARTS

PART_BYTES = 32 << 20
#: How many texts a task remembers what it read in, and how long they may be: headings, tables and forms repeat.
KEPT, SHORT = 1 << 14, 200
#: The terms that announce each kind of fact.
TERMS = {
    "role": ("formann", "leder", "styreleder", "nestformann", "sekretær", "kasserer", "oppmann", "trener", "direktør", "æresmedlem", "æresmedlemmer", "sportslig leder", "daglig leder"),
    "lineup": ("lagoppstilling", "lagoppstillingen", "laget bestod", "spillertropp", "spillerstall", "troppen", "stallen"),
    "season": ("sluttabell", "tabellen", "seriemester", "opprykk", "nedrykk", "poeng", "målforskjell"),
    "fixture": ("terminliste", "terminlisten", "termin", "vårens kamper", "høstens kamper", "seriekamper", "vårens seriekamper", "høstens seriekamper", "kampoppsett", "program", "serieprogram", "kamptermin", "kommende kamper"),
}
#: What announces a lineup, how far behind it names are read and a year is looked for around it, the fewest names, and words that are none.
TRIGGER = r"\b(?:[a-zæøå]*laget|lagoppstillingen|lagoppstilling|troppen|spillertroppen|mannskapet|stallen|spillerstallen)\b[^.]{0,80}?(?::|\bav\b|\bvar\b)\s*"
REACH, NEAR, LEAST, WHOLE = 600, 200, 7, 11
NO_NAMES = ("dommeren", "dommer", "banen", "kampen", "laget", "klubben", "stillingen", "fotballklub", "fotballklubb", "resultatet", "publikum")
#: The first and last year that a fact may have.
YEARS = (1914, 2100)

_OTHER = regex.compile(r"[^a-z0-9æø]+")
#: What folding makes of each character of ASCII.
_PLAIN = "".join(c.lower() if (c := chr(i)).isalnum() else " " for i in range(128))
_YEAR = regex.compile(r"\b(?:19|20)\d{2}\b")
_SCORE = regex.compile(r"\b(\d{1,2})\s*(?:[-–—]|\s:\s)\s*(\d{1,2})\b")
_NAMES = regex.compile(r"\b\p{Lu}[\p{L}.'’-]+(?:\s+\p{Lu}[\p{L}.'’-]+){1,3}\b")
_TITLED = regex.compile(r"^(?:Formann|Styreleder|Nestformann|Sekretær|Kasserer|Oppmann|Trener|Direktør)\s+", regex.I)
_TRIGGER = regex.compile(TRIGGER, regex.I)
_TOKEN = r"[A-ZÆØÅÀ-Þ][\p{L}'’.-]*"
_LISTED = regex.compile(rf"({_TOKEN}(?:\s+{_TOKEN}){{1,3}})\s*(,|\bog\b|$)")


def folded(text: str) -> str:
    if text.isascii():
        return " ".join(text.translate(_PLAIN).split())
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return _OTHER.sub(" ", plain).strip()


def _parts(spark: SparkSession, dictionary: DataFrame) -> list:
    """The dictionary (kind, ref, form) in broadcast parts of a bounded size."""
    rows = dictionary.select("kind", F.col("ref").cast("string").alias("ref"), "form").filter("form IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("form") + F.coalesce(F.octet_length("ref"), F.lit(0)) + 32)).first()[0] or 0
    n = int(size // PART_BYTES) + 1
    part = F.pmod(F.xxhash64("form"), F.lit(n))
    return [spark.sparkContext.broadcast([tuple(r) for r in rows.filter(part == i).collect()]) for i in range(n)]


def _automaton(entries: list[tuple]):
    """An automaton over the folded forms, each between spaces, or None without any."""
    import ahocorasick

    held: dict[str, list[tuple]] = {}
    for kind, ref, form in entries:
        if key := folded(form):
            held.setdefault(f" {key} ", []).append((kind, ref, form))
    if not held:
        return None
    machine = ahocorasick.Automaton()
    for key, found in held.items():
        machine.add_word(key, (len(key), found))
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def _machine(part):
    """The automaton of a part, built once by a worker for all tasks that it runs on it."""
    return _automaton(part.value)


def term_hits(texts: DataFrame, key: Sequence[str], text: str, dictionary: DataFrame) -> DataFrame:
    """(key..., kind, ref, form, at): every place where a dictionary's form stands as whole words; at is its place in the folded text."""
    kinds = [texts.schema[k] for k in key]
    schema = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds) + ", kind string, ref string, form string, at int"

    def scanned(part) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(part)
            for batch in batches if machine else ():
                rows, found = [], []
                for i, value in enumerate(batch.column(len(key)).to_pylist()):
                    for end, (size, entries) in machine.iter(f" {folded(value)} ") if value else ():
                        for entry in entries:
                            rows.append(i)
                            found.append((*entry, end - size + 1))
                columns = list(zip(*found, strict=True)) or [[]] * 4
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(key))), *(pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int32()], strict=True))], [*key, "kind", "ref", "form", "at"])

        return texts.select(*key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(scanned, _parts(texts.sparkSession, dictionary)))


def windows(lines: DataFrame, on: Sequence[str], line: str, text: str) -> DataFrame:
    """Lines, and each with the next one of its page: (on..., line, wide, window)."""
    ahead = F.lead(text).over(Window.partitionBy(*on).orderBy(line))
    both = lines.select(*on, line, F.col(text).alias("_one"), ahead.alias("_two"))
    pair = F.when(F.col("_two").isNotNull(), F.concat_ws(" ", "_one", "_two"))
    entries = F.array(F.struct(F.lit(False).alias("wide"), F.col("_one").alias("window")), F.struct(F.lit(True).alias("wide"), pair.alias("window")))
    return both.select(*on, line, F.inline(entries)).filter("window IS NOT NULL")


def names_in(text: str) -> list[str]:
    found = (_TITLED.sub("", n.strip()) for n in _NAMES.findall(text))
    return list(dict.fromkeys(n for n in found if 5 <= len(n) <= 80))


def years_in(text: str) -> list[int]:
    return list(dict.fromkeys(y for x in _YEAR.findall(text) if YEARS[0] <= (y := int(x)) <= YEARS[1]))


def scores_in(text: str) -> list[str]:
    if not any(c in text for c in "-–—:"):
        return []
    return list(dict.fromkeys(f"{int(a)}-{int(b)}" for a, b in _SCORE.findall(text)))


def _read(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Adds names, years and scores that a window prints, the references of each kind that it names, and the forms of persons (known). Rows are distinct. What one
    automaton finds stays in its row; rows meet again only where the dictionary has several."""
    kinds = [*TERMS, "person"]
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = f"{given}, names array<string>, years array<int>, scores array<string>, {', '.join(f'{k} array<string>' for k in [*kinds, 'known'])}"
    strings = pa.list_(pa.string())

    def scanned(part) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, none, fields = _machine(part), [], [*kinds, "known"]

            def read(text: str) -> tuple:
                met: dict[str, set] = {}
                for _, (_, entries) in machine.iter(f" {folded(text)} ") if machine and text else ():
                    for kind, ref, form in entries:
                        if ref is not None:
                            met.setdefault(kind, set()).add(ref)
                        if kind == "person":
                            met.setdefault("known", set()).add(form)
                return names_in(text), years_in(text), scores_in(text), *(sorted(met[k]) if k in met else none for k in fields)

            remembered = lru_cache(maxsize=KEPT)(read)
            for batch in batches:
                values = batch.column(batch.schema.names.index(column)).to_pylist()
                cells = list(zip(*(remembered(v) if len(v) <= SHORT else read(v) for v in values), strict=True)) or [[]] * (3 + len(fields))
                made = [pa.array(c, pa.list_(pa.int32()) if i == 1 else strings) for i, c in enumerate(cells)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "names", "years", "scores", *fields])

        return df.mapInArrow(run, schema)

    parts = [scanned(part) for part in _parts(df.sparkSession, dictionary)]
    if len(parts) == 1:
        return parts[0]
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in [*kinds, "known"]]
    return reduce(DataFrame.unionByName, parts).groupBy(*df.columns).agg(*(F.first(k).alias(k) for k in ("names", "years", "scores")), *merged)


def candidates(lines: DataFrame, on: Sequence[str], line: str, text: str, people: DataFrame, own: Column | None = None) -> DataFrame:
    """Typed candidates of every page: (on..., id, kind, confidence, keywords, names, years, scores, people). people: person, name (one row a name). A printed
    score is a candidate where ``own`` (a condition on columns of ``on``) holds: whose publication it is. Equal candidates of a page stand once."""
    # Distinct within a page: rows stay where the next line was looked up. They are dealt over parts that adaptive plans don't join to fewer: reading takes
    # far longer than its bytes let expect.
    dealt = lines.select(*on, line, text).repartition(PARTS, *on)
    seen = windows(dealt, on, line, text).select(*on, "window").distinct()
    terms = lines.sparkSession.createDataFrame([(k, t, t) for k, ts in TERMS.items() for t in ts], "kind string, ref string, form string")
    dictionary = terms.unionByName(people.select(F.lit("person").alias("kind"), F.col("person").cast("string").alias("ref"), F.col("name").alias("form")))
    rows, none = _read(seen, "window", dictionary), F.array().cast("array<string>")
    some = lambda c: F.size(c) > 0
    one_person, both = F.size("person") == 1, F.array_distinct(F.concat("known", "names"))
    no_years = F.array().cast("array<int>")
    sure = lambda c: F.when(c, "high").otherwise("medium")

    def made(when: Column, kind: Column, confidence: Column, keywords, names, years, scores, persons) -> Column:
        cells = {"kind": kind, "confidence": confidence, "keywords": keywords, "names": names, "years": years, "scores": scores, "people": persons}
        return F.when(when, F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cells.items())))

    found = F.array(
        made(some("person"), F.lit("person_mention"), sure(one_person), none, "known", "years", none, "person"),
        made(some("role"), F.when(F.size(both) > 0, "person_role").otherwise("organization"), sure(one_person & some("years")), "role", both, "years", none, "person"),
        made(some("lineup"), F.lit("lineup_or_squad"), F.lit("medium"), "lineup", "names", "years", none, "person"),
        made(some("fixture"), F.lit("fixture_list"), F.lit("medium"), "fixture", "names", "years", none, "person"),
        made(some("season") & some("years"), F.lit("season_fact"), F.lit("medium"), "season", none, "years", "scores", none),
        made(some("scores") & (F.lit(True) if own is None else own), F.lit("match_result"), F.lit("medium"), none, "names", "years", "scores", none),
    )
    # Whole rows are told apart by hashing; by their ids, each task would sort them first.
    each = rows.select(*on, F.inline(found)).filter("kind IS NOT NULL").withColumn("years", F.coalesce("years", no_years)).distinct()
    mark = F.sha2(F.to_json(F.struct(*on, "kind", "confidence", "keywords", "names", "years", "scores", "people")), 256)
    return each.withColumn("id", F.concat(F.translate("kind", "_", "-"), F.lit("-"), F.substring(mark, 1, 16)))


def linked_results(found: DataFrame, clubs: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, match_ids, confidence): candidates of kind match_result with the matches of their years in which one of the clubs they name was the opponent
    and which ended in one of the printed scores, in that order; one alone is sure. clubs: id, opponent (the clubs that the candidate names); matches:
    match, season, opponent, score (``2-1``)."""
    rows = found.filter("kind = 'match_result'").join(clubs, "id").select("id", "opponent", F.explode("years").alias("season"), "scores")
    met = rows.withColumn("score", F.explode("scores")).drop("scores").join(matches, ["season", "opponent", "score"])
    ids = met.groupBy("id").agg(F.array_sort(F.collect_set("match")).alias("match_ids"))
    return ids.withColumn("confidence", F.when(F.size("match_ids") == 1, "high").otherwise("medium"))


def listed_names(run: str) -> list[str]:
    """The names at the beginning of an enumeration, up to the first part that is none."""
    out: list[str] = []
    for m in _LISTED.finditer(run):
        name = regex.sub(r"[.,;:]+$", "", m[1].strip())
        words = name.split()
        fine = 2 <= len(words) <= 4 and not any(folded(w) in NO_NAMES or (len(w) > 3 and w == w.upper()) or len(w.replace(".", "")) < 2 for w in words)
        if not fine:
            break
        if name not in out:
            out.append(name)
    return out


def lineups(texts: DataFrame, on: Sequence[str], text: str, people: DataFrame, published: str | None = None) -> DataFrame:
    """(on..., id, season, names, people, confidence): runs of at least ``LEAST`` names behind words that announce a lineup. season is the first year close to
    it, if not after the publication's (``published``, a column of ``on``); people are those that the register knows, by the name as written. Equal lineups of a page stand
    once."""
    kinds = [texts.schema[k] for k in on]
    schema = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds) + ", names array<string>, season int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, seasons = [], [], []
            for i, value in enumerate(batch.column(len(on)).to_pylist()):
                for m in _TRIGGER.finditer(value or ""):
                    found = listed_names(value[m.end() : m.end() + REACH])
                    if len(found) >= LEAST:
                        year = _YEAR.search(value[max(0, m.start() - NEAR) : m.start() + NEAR])
                        rows.append(i)
                        names.append(found)
                        seasons.append(int(year[0]) if year else None)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(on))), pa.array(names, pa.list_(pa.string())), pa.array(seasons, pa.int32())], [*on, "names", "season"])

    fold = F.pandas_udf(lambda s: s.map(lambda x: folded(x) if x else None), "string")
    found = texts.select(*on, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
    if published:
        found = found.withColumn("season", F.when(F.col(published).isNull() | (F.col("season") <= F.col(published)), F.col("season")))
    keyed = found.withColumn("id", F.concat(F.lit("lineup-"), F.substring(F.sha2(F.to_json(F.struct(*on, "names")), 256), 1, 16))).dropDuplicates(["id"])
    register = people.select("person", fold("name").alias("_form")).filter("_form <> ''").groupBy("_form").agg(F.min("person").alias("person"))
    each = keyed.select("id", F.posexplode("names").alias("_at", "_name")).withColumn("_form", fold("_name"))
    known = each.join(register, "_form").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "person"))), lambda x: x["person"]).alias("people"))
    out = keyed.join(known, "id", "left").withColumn("people", F.coalesce("people", F.array().cast(known.schema["people"].dataType)))
    sure = (F.size("names") >= WHOLE) & (F.size("people") >= F.size("names") / 2)
    return out.select(*on, "id", "season", "names", "people", F.when(sure, "high").otherwise("medium").alias("confidence"))
