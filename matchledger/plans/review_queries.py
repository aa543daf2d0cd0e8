"""Queries on rules for short texts, and on reports over roles, claims and reviews, with records made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import ENCOUNTERS_SQL, PARTS, encounters, table
from ..functions import bindings, classify, dates, text
from ..operators import allocation, evidence, identity, reports

NOTES = ("hjemmekamp", "Bortekamp i cupen", "omkamp, finale", "2. divisjon", "kval.-kamp på Vigra", "ekstraomganger", "privatkamp (h)", "seriekamp i Oslo", "NM", "Tippecup", "3.div", "")
REMARKS = ("Relegated", "promotion play-off", "Relegation Playoff", "Tables only", "round by round", "Play-off winner", "Promoted to 1. div", "kun tabell", "in the middle")
TITLES = ("Formann", "Formann i banen", "Trener", "Trener for junior", "Kasserer")
FIELDS = ("score", "date", "name", "coach of 1990", "venue")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _picked(values: tuple[str, ...], n: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({n} % {len(values)} AS INTEGER) + 1]"


def claims_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.claims(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_claims"), F.md5(F.array_join(found, "|").cast("binary")).alias("digest"))


CLAIMS_SPLIT_SQL = r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\b(dr|st|jr|sr|kl|ca|bl|dvs|feks|mfl|osv|fk|aa|a|f|k)\.', '\1' || chr(57344), 'g'), '([.!?])\s+([A-ZÆØÅ])', '\1' || chr(10) || '\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_split_to_array(t, '[\r\n]+|;\s+|\s+(?:mens|derimot)\s+|\s+i\s+en\s+annen\s+(?:kamp|notis)\s+') AS l FROM m),
c AS (SELECT doc_id, [y for y in [regexp_replace(replace(x, chr(57344), '.'), '^\s+|\s+$', '', 'g') for x in l] if y <> ''] AS l FROM p)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_claims, md5(coalesce(array_to_string(l, '|'), '')) AS digest FROM c WHERE l IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL"""


def compared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = {"in_text": text.compared_name(F.col("text")), "with_rings": text.compared_name(F.col("text"), rings=True), "joined": text.compared_name(F.col("text"), markup=False, spaces=False)}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.md5(c.cast("binary")).alias(n) for n, c in forms.items()))


_BARE = "lower(regexp_replace(text, '(?i)</?(?:em|strong|b|i)>', ' ', 'g'))"
COMPARED_SQL = f"""
SELECT doc_id, md5(trim(regexp_replace(strip_accents({_BARE}), '[^a-z0-9æøå]+', ' ', 'g'))) AS in_text,
  md5(trim(regexp_replace(strip_accents(replace({_BARE}, 'å', 'aa')), '[^a-z0-9æøå]+', ' ', 'g'))) AS with_rings,
  md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9æøå]+', '', 'g')) AS joined FROM documents"""


def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat("text", F.lit(" "), (1900 + F.col("conv_id") % 250).cast("string"), F.lit(" 1950 12345"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.parsed_search(asked).alias("p"))
    return rows.select("conv_id", "turn", F.array_join("p.years", ",").alias("years"), F.array_join("p.terms", " ").alias("terms"))


PARSED_SQL = r"""
WITH t AS (SELECT conv_id, turn, [x for x in regexp_split_to_array(lower(text || ' ' || CAST(1900 + conv_id % 250 AS VARCHAR) || ' 1950 12345'), '\s+') if x <> ''] AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN 1900 + conv_id % 250 IN (1950) OR 1900 + conv_id % 250 NOT BETWEEN 1914 AND 2100 THEN '1950' ELSE CAST(1900 + conv_id % 250 AS VARCHAR) || ',1950' END AS years,
  array_to_string([x for x in l if NOT coalesce(regexp_full_match(x, '[0-9]{4}') AND TRY_CAST(x AS INTEGER) BETWEEN 1914 AND 2100, FALSE)][1:6], ' ') AS terms
FROM t WHERE l IS NOT NULL"""


def club_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        n,
        F.concat(F.lit("klubb-"), n.cast("string"), F.lit("-il")).alias("ident"),
        F.when(n % 7 != 1, F.concat(F.lit("IL "), "n_name", F.lit(" Fotball"))).otherwise("").alias("name"),
        F.when(n % 5 == 0, F.concat(F.lit("own-"), n.cast("string"))).alias("own"),
    )
    forms = text.club_forms(F.col("ident"), F.col("name"), F.lit(None).cast("string"), F.array(F.lit("Gamle"), F.lit("")), F.lit(None).cast("array<string>"))
    return rows.select("n_nationkey", text.club_key(F.col("own"), F.col("name"), F.col("ident")).alias("club_key"), F.array_join(forms, "|").alias("forms"))


CLUBS_SQL = """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'own-' || n_nationkey WHEN n_nationkey % 7 <> 1 THEN regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') ELSE 'klubb-' || n_nationkey END AS club_key,
  'klubb-' || n_nationkey || '-il|' || CASE WHEN n_nationkey % 7 <> 1 THEN 'IL ' || n_name || ' Fotball|' ELSE '' END || 'Gamle' AS forms FROM nation"""


def encoding_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.concat(F.regexp_replace("text", "[^\\x00-\\x7F]", "�"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_encoding_repair(damaged, F.col("text")).alias("repaired"))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = dates.local_time(F.col("ts") + F.make_interval(days=(F.col("event_id") % 365).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", local.alias("l")).select("event_id", F.col("l.date").alias("day"), F.col("l.time").alias("kickoff"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat_ws(" ", _pick(NOTES, k), _pick(NOTES, F.floor(k / 12))).alias("note"), (1940 + k % 60).cast("int").alias("season"), F.when(k % 4 == 0, "Rollon*").otherwise("Rollon").alias("opponent"))


_NOTES = f"n AS (SELECT {_picked(NOTES, 'o_orderkey')} || ' ' || {_picked(NOTES, '(o_orderkey // 12)')} AS note, CAST(1940 + o_orderkey % 60 AS INTEGER) AS season, o_orderkey % 4 = 0 AS starred FROM orders), l AS (SELECT *, lower(note) AS t FROM n)"


def note_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir).groupBy("note").agg(F.count("*").alias("n")).withColumn("h", classify.note_hints(F.col("note")))
    return rows.select("note", "n", "h.competition", "h.side", "h.replay", "h.extra_time", F.array_join("h.keywords", ",").alias("keywords"))


_WORDS = " ".join(f"WHEN regexp_matches(t, '{p}') THEN [{', '.join(repr(w) for w in words)}]" for p, _, words in classify.NOTED)
_HINTS = " ".join("WHEN regexp_matches(t, '{}') THEN {}".format(p, "regexp_extract(t, '(\\d)\\.?\\s?divisjon', 1) || '. divisjon'" if h == "divisjon" else repr(h)) for p, h, _ in classify.NOTED)
NOTE_SQL = f"""
WITH {_NOTES}, g AS (SELECT note, t, count(*) AS n FROM l GROUP BY note, t)
SELECT note, n, CASE {_HINTS} END AS competition, CASE WHEN regexp_matches(t, '\\b(bortekamp|borte)\\b') THEN 'away' WHEN regexp_matches(t, '\\b(hjemmekamp|hjemme)\\b') THEN 'home' END AS side,
  regexp_matches(t, '\\bomkamp\\b') AS replay, t LIKE '%ekstraomgang%' AS extra_time,
  array_to_string(list_concat(CASE {_WORDS} ELSE [] END, CASE WHEN regexp_matches(t, '\\bomkamp\\b') THEN ['omkamp'] ELSE [] END, CASE WHEN t LIKE '%ekstraomgang%' THEN ['ekstraomganger'] ELSE [] END, CASE WHEN regexp_matches(t, '\\bfinale\\b') THEN ['finale'] ELSE [] END), ',') AS keywords
FROM g"""


def noted_competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir).groupBy(classify.competition_hint(F.col("note"), F.col("season")).alias("competition"), classify.side_hint(F.col("note"), F.col("opponent")).alias("side"))
    return rows.agg(F.count("*").alias("n"), F.min("season").alias("first"))


NOTED_SQL = f"""
WITH {_NOTES}
SELECT CASE WHEN t LIKE '%nm%' OR t LIKE '%cup%' THEN 'nm' WHEN t LIKE '%privat%' THEN 'treningskamp' WHEN t LIKE '%3.div%' THEN 'andredivisjon' WHEN t LIKE '%2. div%' THEN CASE WHEN season < 1963 THEN 'andredivisjon' ELSE 'forstedivisjon' END END AS competition,
  CASE WHEN t LIKE '%hjemme%' OR t LIKE '%(h)%' THEN 'home' WHEN t LIKE '%borte%' OR t LIKE '%i oslo%' OR t LIKE '%på vigra%' THEN 'away' WHEN starred THEN 'away' END AS side, count(*) AS n, min(season) AS first
FROM l GROUP BY 1, 2"""


def remark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick(REMARKS, F.col("p_partkey"))
    known = F.when(F.col("p_partkey") % 11 == 0, "cup")
    keys = {"outcome": classify.outcome(said), "label": classify.label_kind(said), "competition": classify.competition_class(known, F.concat_ws(" ", said, F.when(F.col("p_size") > 25, "League")))}
    return table(spark, sf_dir, "part").groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.count("*").alias("n"))


REMARK_SQL = f"""
SELECT CASE WHEN s IN ('Relegation Playoff') THEN 'relegation_playoff' WHEN s = 'promotion play-off' THEN 'promotion_playoff' WHEN s = 'Relegated' THEN 'relegated' WHEN s LIKE 'Promoted%' THEN 'promoted' WHEN s LIKE 'Play-off%' THEN 'playoff' ELSE 'none' END AS outcome,
  CASE WHEN s IN ('Tables only', 'kun tabell') THEN 'tables_only' WHEN s = 'round by round' THEN 'match_list' ELSE 'unknown' END AS label,
  CASE WHEN p_partkey % 11 = 0 THEN 'cup' WHEN p_size > 25 THEN 'league' ELSE 'other' END AS competition, count(*) AS n
FROM (SELECT p_partkey, p_size, {_picked(REMARKS, 'p_partkey')} AS s FROM part) GROUP BY 1, 2, 3"""


def printed_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 5 == 0, "x").otherwise(F.concat((e % 121).cast("string"), F.when(e % 3 == 0, F.concat(F.lit(" + "), (e % 7).cast("string"))).otherwise("'")))
    rows = table(spark, sf_dir, "events").select("event_id", classify.minute(said, F.when(e % 4 == 0, F.lit(2))).alias("m"))
    return rows.select("event_id", "m.minute", "m.stoppage")


MINUTES_SQL = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 121 AS INTEGER) END AS minute, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN nullif(CAST(event_id % 7 AS INTEGER), 0) WHEN event_id % 4 = 0 THEN 2 END AS stoppage FROM events"


def paper_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    view, place = F.when(d % 3 != 0, F.when(d % 3 == 1, "ALL").otherwise("LIBRARY")), F.when(d % 4 == 0, "LIBRARY").when(d % 4 == 1, "EVERYWHERE")
    issued = F.when(d % 5 != 0, F.concat(F.lit("1952040"), (d % 9 + 1).cast("string")))
    line = classify.attribution(F.coalesce("source", F.lit("?")), issued, F.when(d % 2 == 0, _pick(("CCBYNC", "cc0", "own"), d)), "Nasjonalbiblioteket")
    return table(spark, sf_dir, "documents").select("doc_id", classify.may_store(view, place).alias("may_store"), line.alias("attribution"))


ACCESS_SQL = f"""
SELECT doc_id, doc_id % 3 = 1 AND doc_id % 4 <> 0 AS may_store, coalesce(source, '?') || ' ' || CASE WHEN doc_id % 5 <> 0 THEN '0' || (doc_id % 9 + 1) || '.04.1952' ELSE 'ukjent dato' END || ', Nasjonalbiblioteket' ||
  CASE WHEN doc_id % 2 = 0 THEN ' (' || {_picked(('CC BY-NC', 'CC0', 'own'), 'doc_id')} || ')' ELSE '' END AS attribution FROM documents"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), _pick(TITLES, k).alias("title"), year.alias("from_year"), F.when(k % 3 != 0, year + (k % 4).cast("int")).alias("to_year"), k.alias("source"))


_ROLES = f"r AS (SELECT o_custkey AS person, {_picked(TITLES, 'o_orderkey')} AS title, CAST(year(o_orderdate) AS INTEGER) AS from_year, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(year(o_orderdate) + o_orderkey % 4 AS INTEGER) END AS to_year, o_orderkey AS source FROM orders)"


def less_precise_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.less_precise(_roles(spark, sf_dir))


def old_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = _roles(spark, sf_dir)
    cited = roles.select("person", "source", (F.col("from_year") - F.col("source") % 12).cast("int").alias("year"))
    return reports.sources_too_old(roles.select("person", F.col("from_year").alias("year")), cited)


def other_coaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("season")
    orders = table(spark, sf_dir, "orders")
    led = orders.select(season, F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey") % 50).alias("coach"))
    said = orders.filter("o_orderkey % 3 = 0").select(((F.col("o_custkey") + F.col("o_orderkey")) % 70).alias("person"), season.alias("year"))
    return reports.other_coaches(said, led)


COACHES_SQL = """
WITH o AS (SELECT *, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS season FROM orders),
l AS (SELECT season, o_custkey % 50 AS coach, count(*) AS n FROM o WHERE o_orderkey % 10 <> 0 GROUP BY ALL),
k AS (SELECT season, coach AS known, n AS known_matches FROM l QUALIFY row_number() OVER (PARTITION BY season ORDER BY n DESC, coach) = 1),
p AS (SELECT DISTINCT season, (o_custkey + o_orderkey) % 70 AS person FROM o WHERE o_orderkey % 3 = 0)
SELECT person, p.season, known, known_matches FROM p JOIN k ON p.season = k.season WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.season = p.season AND l.coach = p.person)"""


def outside_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    spells = table(spark, sf_dir, "customer").select(c.alias("person"), (1992 + c % 5).cast("int").alias("from_year"), F.when(c % 3 != 0, (1992 + c % 5 + c % 3).cast("int")).alias("to_year"))
    found = reports.outside_spell(spells, _roles(spark, sf_dir).filter("title LIKE 'Trener%'"))
    return found.withColumn("outside", F.array_join("outside", ","))


OUTSIDE_SQL = f"""
WITH {_ROLES}, s AS (SELECT c_custkey AS person, CAST(1992 + c_custkey % 5 AS INTEGER) AS spell_from, CASE WHEN c_custkey % 3 <> 0 THEN CAST(1992 + c_custkey % 5 + c_custkey % 3 AS INTEGER) END AS spell_to FROM customer),
m AS (SELECT s.*, title, unnest(generate_series(from_year, coalesce(to_year, from_year))) AS y FROM s JOIN r ON r.person = s.person WHERE title LIKE 'Trener%' AND from_year <= coalesce(spell_to, spell_from) AND coalesce(to_year, from_year) >= spell_from),
g AS (SELECT person, spell_from, spell_to, array_to_string(list_sort(list(DISTINCT title)), '/') AS titles, array_to_string(list_sort(list(DISTINCT y) FILTER (y < spell_from OR y > coalesce(spell_to, spell_from))), ',') AS outside FROM m GROUP BY person, spell_from, spell_to)
SELECT * FROM g WHERE outside <> ''"""


def suspicious_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(_pick(("Ole", "R.", "A", "HANS", "Per", "NTB"), k), F.lit(" "), _pick(("Olsen", "Ol|sen", "Eck Olsen", "Li A", "<Moe>"), k))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).filter(reports.suspicious_name(F.col("name")))


NAMES_SQL = f"""
SELECT c_custkey, name FROM (SELECT c_custkey, {_picked(('Ole', 'R.', 'A', 'HANS', 'Per', 'NTB'), 'c_custkey')} || ' ' || {_picked(('Olsen', 'Ol|sen', 'Eck Olsen', 'Li A', '<Moe>'), 'c_custkey')} AS name FROM customer)
WHERE regexp_matches(name, '(^|\\s)[^.\\s](\\s|$)') OR regexp_matches(name, '[\\[\\]{{}}|<>]') OR regexp_matches(name, '(^|\\s)HANS(\\s|$)')"""


def verification_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 2 == 0, "person").otherwise("match")
    conflicts = table(spark, sf_dir, "lineitem").select(
        kind.alias("kind"), F.col("l_orderkey").alias("ident"), _pick(FIELDS, F.col("l_partkey")).alias("field"), F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("int")).alias("value"),
        F.when(F.col("l_linestatus") == "O", "unresolved").otherwise("chosen").alias("decision"),
    )
    cases = table(spark, sf_dir, "orders").select(F.lit("match").alias("kind"), F.col("o_orderkey").alias("ident"), _pick(FIELDS, F.col("o_custkey")).alias("field"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    return reports.candidates(conflicts, cases).withColumn("values", F.array_join("values", ","))


CANDIDATES_SQL = f"""
WITH c AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'person' ELSE 'match' END AS kind, l_orderkey AS ident, {_picked(FIELDS, 'l_partkey')} AS field, CASE WHEN l_quantity < 40 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE 'ukjent' END AS value FROM lineitem WHERE l_linestatus = 'O'),
v AS (SELECT o_orderkey AS ident, {_picked(FIELDS, 'o_custkey')} AS field FROM orders WHERE o_orderstatus <> 'F')
SELECT kind, ident, field, array_to_string(list_sort(list(DISTINCT value)), ',') AS values, CASE WHEN kind = 'person' THEN CASE WHEN field IN ('name', 'coach of 1990') THEN 88 ELSE 72 END ELSE CASE field WHEN 'score' THEN 98 WHEN 'date' THEN 92 ELSE 78 END END AS urgency
FROM c WHERE NOT (kind = 'match' AND EXISTS (SELECT 1 FROM v WHERE v.ident = c.ident AND v.field = c.field)) GROUP BY kind, ident, field"""


def review_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("coordinate"), F.col("o_custkey").alias("claim_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("no"))
    n = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("asked", F.when(n % 17 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")))
    known = lines.join(claims.withColumnRenamed("coordinate", "l_orderkey"), "l_orderkey")
    reviews = known.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review"), "asked", F.when(n % 5 != 0, F.col("claim_id") + (n % 5 == 1).cast("int")).alias("claim_id"),
        F.when(n % 3 != 0, F.col("season") + (n % 3 == 1).cast("int")).alias("season"), F.when(n % 2 == 0, F.col("no") + (n % 4 == 0).cast("int")).alias("no"),
    )
    return reports.review_validity(reviews, claims).groupBy("validity").agg(F.count("*").alias("n"), F.min("review").alias("first"))


VALIDITY_SQL = """
SELECT CASE WHEN l_partkey % 17 = 0 AND l_orderkey <> 0 THEN 'unknown_claim' WHEN l_partkey % 5 = 1 THEN 'invalid' WHEN l_partkey % 3 = 1 THEN 'requires_revalidation' WHEN l_partkey % 4 = 0 THEN 'coordinate_changed_but_semantics_unchanged' ELSE 'valid' END AS validity,
  count(*) AS n, min(l_orderkey || '-' || l_linenumber) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""


def claim_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ident = F.when(k % 31 == 0, "").when(k % 37 == 0, F.concat(F.lit("claim-"), k.cast("string"))).otherwise(F.concat(F.lit("srcclaim-"), F.md5(F.when(k % 41 == 0, k + 1).otherwise(k).cast("string").cast("binary"))))
    claims = table(spark, sf_dir, "orders").select(ident.alias("claim_id"), k.cast("string").alias("coordinate"))
    named = F.concat(F.lit("srcclaim-"), F.md5(k.cast("string").cast("binary")))
    lineage = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 3").select(named.alias("claim_id"), F.when(k % 100 == 3, k).otherwise(k + 1).cast("string").alias("coordinate"))
    references = table(spark, sf_dir, "orders").filter("o_custkey % 40 = 0").select(named.alias("claim_id"), F.concat(F.lit("case "), k.cast("string")).alias("place"))
    return reports.claim_integrity(claims, lineage, references)


INTEGRITY_SQL = """
WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS coordinate, CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN 'claim-' || o_orderkey ELSE 'srcclaim-' || md5(CAST(CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS VARCHAR)) END AS claim_id FROM orders),
k AS (SELECT claim_id, count(*) AS n, min(coordinate) AS coordinate FROM c WHERE claim_id <> '' GROUP BY claim_id),
t AS (SELECT 'srcclaim-' || md5(CAST(o_orderkey AS VARCHAR)) AS claim_id, CAST(CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey ELSE o_orderkey + 1 END AS VARCHAR) AS said FROM orders WHERE o_orderkey % 50 = 3)
SELECT 'missing' AS fault, coordinate AS about FROM c WHERE claim_id = '' UNION ALL SELECT 'form', claim_id FROM c WHERE claim_id LIKE 'claim-%'
UNION ALL SELECT 'duplicate', claim_id FROM k WHERE n > 1 UNION ALL SELECT 'lineage_without_claim', claim_id FROM t WHERE claim_id NOT IN (SELECT claim_id FROM k)
UNION ALL SELECT 'lineage_elsewhere', claim_id FROM t JOIN k USING (claim_id) WHERE said <> coordinate
UNION ALL SELECT 'reference_without_claim', 'case ' || o_orderkey FROM orders WHERE o_custkey % 40 = 0 AND 'srcclaim-' || md5(CAST(o_orderkey AS VARCHAR)) NOT IN (SELECT claim_id FROM k)"""


def documented_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, month = F.col("o_orderkey"), F.month("o_orderdate")
    o = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate") * 100 + month)
    claims = o.select((F.col("season") + 6).alias("season"), F.when(k % 6 == 0, k).alias("match_id"), F.when(k % 2 == 0, F.col("o_custkey") % 97).cast("string").alias("group_id"), k.cast("string").alias("claim_id"))
    return reports.documented_years(o.filter("o_orderstatus = 'F'").select("season", F.lit(1).alias("played")), claims)


YEARS_SQL = """
WITH o AS (SELECT *, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS season FROM orders),
c AS (SELECT season + 6 AS season, o_orderkey % 6 = 0 AS linked, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 97 END AS g, o_orderkey AS k FROM o),
d AS (SELECT season, count(DISTINCT coalesce('g' || g, 'c' || k)) AS documented FROM c WHERE NOT linked AND (g IS NULL OR g NOT IN (SELECT g FROM c WHERE linked AND g IS NOT NULL)) GROUP BY season),
p AS (SELECT season, count(*) AS played FROM o WHERE o_orderstatus = 'F' GROUP BY season)
SELECT season, coalesce(played, 0) AS played, coalesce(documented, 0) AS documented FROM p FULL JOIN d USING (season)"""


def extra_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") % 2 == 0).alias("is_home"), (F.col("l_suppkey") % 10 == 0).alias("own_goal"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey") % 120 + 1).alias("minute"), (F.col("l_linestatus") == "F").alias("shootout"),
    )
    at_home = goals.filter("NOT shootout").groupBy("match_id").agg(F.count_if(F.col("is_home") != F.col("own_goal")).alias("home"), F.count_if(F.col("is_home") == F.col("own_goal")).alias("away"))
    said = F.when(F.col("match_id") % 9 == 0, 1).otherwise(0)
    return reports.extra_time(at_home.select("match_id", (F.col("home") + said).alias("home"), "away"), goals)


EXTRA_SQL = """
WITH g AS (SELECT l_orderkey AS match_id, (l_linenumber % 2 = 0) <> (l_suppkey % 10 = 0) AS h, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey % 120 + 1 END AS m FROM lineitem WHERE l_linestatus <> 'F'),
s AS (SELECT match_id, count(*) FILTER (h) AS home, count(*) FILTER (NOT h) AS away, count(*) FILTER (h AND m <= 90) AS h90, count(*) FILTER (NOT h AND m <= 90) AS a90, count(*) FILTER (m IS NULL) AS bad FROM g GROUP BY match_id),
t AS (SELECT *, CASE WHEN bad > 0 THEN 'unreadable' WHEN match_id % 9 = 0 THEN 'unexplained' ELSE 'split' END AS state, CASE WHEN match_id % 9 = 0 THEN home + 1 ELSE home END AS said FROM s)
SELECT match_id, state, CAST(CASE WHEN state = 'split' THEN h90 ELSE said END AS INTEGER) AS home_score, CAST(CASE WHEN state = 'split' THEN a90 ELSE away END AS INTEGER) AS away_score,
  CAST(CASE WHEN state = 'split' AND home + away > h90 + a90 THEN home - h90 END AS INTEGER) AS extra_home, CAST(CASE WHEN state = 'split' AND home + away > h90 + a90 THEN away - a90 END AS INTEGER) AS extra_away FROM t"""


def shootouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    matches = table(spark, sf_dir, "orders").select(k.alias("match_id"), F.when(k % 4 == 0, F.array(F.lit(4), (k % 3).cast("int"))).when(k % 4 == 1, F.array(F.lit(4))).alias("summary"), F.when(k % 2 == 0, F.array(F.lit(5), F.lit(6))).alias("header"))
    shots = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") % 2 == 0).alias("is_home"), (F.col("l_returnflag") == "A").alias("scored"))
    return reports.shootouts(matches, shots)


SHOOTOUT_SQL = """
WITH s AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber % 2 = 0 AND l_returnflag = 'A') AS h, count(*) FILTER (l_linenumber % 2 = 1 AND l_returnflag = 'A') AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS match_id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 4 WHEN k IS NOT NULL THEN h ELSE 5 END AS INTEGER) AS home, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 WHEN k IS NOT NULL THEN a ELSE 6 END AS INTEGER) AS away
FROM orders LEFT JOIN s ON o_orderkey = k WHERE o_orderkey % 2 = 0 OR k IS NOT NULL"""


def loose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lambda k, middle, last: F.concat(F.lit("Ole "), F.chr(65 + k % middle), F.lit(" Bjørn"), (k % last).cast("string"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), full(F.col("c_custkey"), 7, 41).alias("name"))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry"), full(F.col("s_suppkey"), 5, 29).alias("label"))
    return reports.loose_names(people, entries)


LOOSE_SQL = """
WITH p AS (SELECT c_custkey AS person, c_custkey % 7 AS m, c_custkey % 41 AS l FROM customer), e AS (SELECT s_suppkey AS entry, s_suppkey % 5 AS m, s_suppkey % 29 AS l FROM supplier),
x AS (SELECT m, l, min(entry) AS entry FROM e GROUP BY ALL), y AS (SELECT l, min(entry) AS low, count(DISTINCT entry) AS n FROM e GROUP BY l)
SELECT person, CASE WHEN x.entry IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'loose' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how, CASE WHEN x.entry IS NOT NULL THEN x.entry WHEN n = 1 THEN low END AS entry
FROM p LEFT JOIN x ON p.m = x.m AND p.l = x.l LEFT JOIN y ON p.l = y.l"""


def batch_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hypothesis"), "o_custkey", F.year("o_orderdate").alias("season"))
    return reports.batch_policy(rows, ["o_custkey", "season"]).select("hypothesis", "siblings", "policy")


def fragment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kinds = ("article", "result_list", "fixture_list", "standings", "coupon", "unknown", "article")
    f = table(spark, sf_dir, "documents").select(
        "doc_id", _pick(kinds, d).alias("kind"), (F.length("text") % 2 == 0).alias("opponent_found"), (d % 3 != 0).alias("own_found"), (d % 5 < 2).alias("match_talk"),
        F.when(d % 4 != 0, d % 4 == 1).alias("score_matches"), (d % 8 == 0).alias("competition_agrees"), (d % 9 == 0).alias("side_agrees"), _pick(("high", "medium", "low", "none"), F.floor(d / 2)).alias("temporal"),
    )
    return evidence.fragment_score(f).select("doc_id", "same_fragment", "evidence_score")


FRAGMENT_SQL = f"""
WITH f AS (SELECT doc_id AS d, {_picked(('article', 'result_list', 'fixture_list', 'standings', 'coupon', 'unknown', 'article'), 'doc_id')} AS kind, length(text) % 2 = 0 AS o, doc_id % 3 <> 0 AS w, {_picked(('high', 'medium', 'low', 'none'), '(doc_id // 2)')} AS t FROM documents)
SELECT d AS doc_id, o AND w AS same_fragment, CAST(CASE kind WHEN 'article' THEN 15 WHEN 'result_list' THEN 5 WHEN 'unknown' THEN 0 ELSE -20 END + CASE WHEN o AND w THEN 25 WHEN o OR w THEN 8 ELSE 0 END + CASE WHEN d % 5 < 2 THEN 15 ELSE 0 END
  + CASE WHEN o AND w AND d % 4 = 1 THEN 25 ELSE 0 END + CASE WHEN d % 8 = 0 THEN 10 ELSE 0 END + CASE WHEN d % 9 = 0 THEN 10 ELSE 0 END
  + CASE WHEN (o AND w) OR d % 5 < 2 THEN CASE t WHEN 'high' THEN 12 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END ELSE 0 END AS INTEGER) AS evidence_score FROM f"""


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("l_partkey")
    pair = lambda h, a: F.struct(h.cast("int").alias("home"), a.cast("int").alias("away"))
    hypotheses = table(spark, sf_dir, "orders").select(
        k.alias("grp"), k.alias("hypothesis"), F.array(pair(k % 3, k % 4)).alias("scores"), F.when(k % 2 == 0, F.array(F.lit("home"))).otherwise(F.array().cast("array<string>")).alias("sides"), F.array(_pick(("cup", "serie"), k)).alias("competitions")
    )
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("grp"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event"), (n % 70).cast("int").alias("score"), F.when(n % 3 == 0, "low").otherwise("high").alias("date_confidence"), (n % 4 == 0).alias("same_fragment"),
        F.when(n % 5 != 0, pair(n % 3, F.col("l_suppkey") % 4)).alias("printed"), F.when(n % 7 < 5, _pick(("home", "away"), n)).alias("side"), F.when(n % 6 != 0, F.array(F.lit("cup"))).otherwise(F.array().cast("array<string>")).alias("competitions"),
        (n % 8 == 0).alias("article"), (n % 3).alias("items"),
    )
    return evidence.edge_scores(hypotheses, events, ["grp"]).select("hypothesis", "event", "edge")


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned lines of each order as claims in the order of their numbers, on its lines as events: an order has at most a few lines."""
    pair = lambda h, a: F.struct(h.cast("int").alias("home"), a.cast("int").alias("away"))
    # Dealt before claims and events are spelled out, over parts that adaptive plans don't join to fewer: solving takes far longer than its bytes let expect.
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate").repartition(PARTS, "l_orderkey")
    n, grp = F.col("l_partkey"), F.col("l_orderkey").alias("grp")
    none = F.array().cast("array<string>")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    claims = lines.filter("l_returnflag = 'R'").select(
        grp, name.alias("hypothesis"), F.col("l_linenumber").cast("int").alias("ord"), F.array(pair(n % 3, n % 2)).alias("scores"), F.when(n % 2 == 0, F.array(F.lit("home"))).otherwise(none).alias("sides"),
        F.when(n % 4 == 0, F.array(F.lit("cup"))).otherwise(none).alias("competitions"), F.when(n % 5 != 0, F.concat_ws("|", n % 3, n % 2, n % 4 == 0)).alias("alike"),
    )
    events = lines.select(
        grp, name.alias("event"), (30 + n % 50).cast("int").alias("score"), F.when(n % 9 != 0, F.col("l_shipdate").cast("date")).alias("date"), F.when(n % 3 == 0, "low").otherwise("high").alias("date_confidence"), (n % 4 != 0).alias("same_fragment"),
        F.when(n % 7 != 0, pair(n % 3, F.col("l_suppkey") % 2)).alias("printed"), F.when(n % 7 < 5, _pick(("home", "away"), n)).alias("side"), F.when(n % 6 == 0, F.array(F.lit("cup"))).otherwise(none).alias("competitions"), (n % 8 == 0).alias("article"), (n % 3).alias("items"),
    )
    edges = evidence.edge_scores(claims, events, ["grp"])
    return allocation.allocated(claims, events.withColumn("printed", F.col("printed").isNotNull()), edges, ["grp"]).withColumn("alternatives", F.transform("alternatives", lambda x: F.concat_ws("=", x["event"], x["score"])))


EDGE_SQL = """
WITH j AS (SELECT o_orderkey AS k, l_orderkey || '-' || l_linenumber AS event, l_partkey AS n, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 3 END AS h, l_suppkey % 4 AS a, o_orderkey % 3 AS eh, o_orderkey % 4 AS ea FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
m AS (SELECT *, coalesce(h = eh AND a = ea, FALSE) AS s, coalesce(h = ea AND a = eh, FALSE) AS t FROM j),
e AS (SELECT k, event, n % 70 + CASE WHEN s THEN 20 WHEN t THEN 15 ELSE 0 END + CASE WHEN k % 2 = 0 AND n % 7 < 5 AND n % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN n % 6 = 0 THEN 0 WHEN k % 2 = 0 THEN 15 ELSE 10 END
  + CASE WHEN n % 8 = 0 THEN 10 ELSE 0 END + CASE WHEN n % 3 > 1 THEN 5 ELSE 0 END AS edge FROM m WHERE (s OR t OR n % 4 = 0) AND NOT (NOT s AND NOT t AND n % 3 = 0 AND n % 70 < 55))
SELECT k AS hypothesis, event, CAST(edge AS INTEGER) AS edge FROM e WHERE edge >= 45"""

#: What a notice says of a match, by its number: outright, in two claims, with another pair, looking back, of another team, of two matches, without a score.
_NOTICES = ("{a} - {b} {h}-{w} i serien.", "{a} vant over {b}. Resultatet ble {h}-{w}.", "{a} så {b} - Grenland {h}-{w}.", "Sist møttes {a} og {b} til {h}-{w}.", "{a} - {b} {h}-{w} i juniorkamp.", "{a} - {b} {h}-{w}. {b} - {a} {w}-{h}.", "{a} møtte {b} i regn.", "{b} - {a} {w}-{h}.")


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice of every encounter, which prints a score other than the recorded one now and then."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap(F.translate("n_name", "_", " ")).alias("name"))
    e = encounters(spark, sf_dir).filter("home_id IS NOT NULL AND away_id IS NOT NULL")
    rows = e.join(names.toDF("home_id", "a"), "home_id").join(names.toDF("away_id", "b"), "away_id")
    n = F.col("home_id") * 7 + F.col("away_id") * 3 + F.col("home_score") * 5 + F.col("away_score")
    printed = F.when(n % 11 == 0, F.col("home_score") + 1).otherwise(F.col("home_score"))
    text = F.get(F.array(*map(F.lit, _NOTICES)), n % len(_NOTICES))
    for hole, value in (("{a}", F.col("a")), ("{b}", F.col("b")), ("{h}", printed.cast("string")), ("{w}", F.col("away_score").cast("string"))):
        text = F.replace(text, F.lit(hole), value)
    return rows.select("match_id", "home_score", "away_score", n.alias("n"), F.array("a").alias("own"), F.array("b").alias("other"), text.alias("text"))


def bound_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each notice proves for its match: the score that its text binds to both names, and what that counts as evidence."""
    read = bindings.fragments(_notices(spark, sf_dir), "text", "own", "other", "home_score", "away_score")
    rows = read.withColumns({"kind": F.lit("article"), "match_talk": F.lit(False), "competition_agrees": F.lit(False), "side_agrees": F.lit(False), "temporal": F.lit(None).cast("string")})
    scored = evidence.fragment_score(rows)
    return scored.select("match_id", F.col("binding.home").alias("home"), F.col("binding.away").alias("away"), "binding.turned", "binding.agrees", "binding.retrospective", "binding.non_senior", "score_matches", "evidence_score")


BOUND_SQL = f"""
WITH {ENCOUNTERS_SQL},
e AS (SELECT *, home_id * 7 + away_id * 3 + home_score * 5 + away_score AS n FROM encounters),
p AS (SELECT *, CASE WHEN n % 11 = 0 THEN home_score + 1 ELSE home_score END AS h, away_score AS w, n % 8 AS t FROM e),
q AS (SELECT *, t IN (0, 1, 3, 4, 7) AS bound, CASE WHEN t = 7 THEN w ELSE h END AS x, CASE WHEN t = 7 THEN h ELSE w END AS y FROM p),
r AS (SELECT *, x = home_score AND y = away_score AS straight, x = away_score AND y = home_score AS backwards FROM q)
SELECT match_id, CASE WHEN bound THEN CAST(x AS INTEGER) END AS home, CASE WHEN bound THEN CAST(y AS INTEGER) END AS away, CASE WHEN bound THEN backwards AND NOT straight END AS turned,
       CASE WHEN bound THEN straight OR backwards END AS agrees, CASE WHEN bound THEN t = 3 END AS retrospective, CASE WHEN bound THEN t = 4 END AS non_senior,
       CASE WHEN t IN (0, 1, 7) THEN straight OR backwards END AS score_matches,
       CAST(15 + 25 + CASE WHEN t IN (0, 1, 7) AND (straight OR backwards) THEN 25 ELSE 0 END AS INTEGER) AS evidence_score FROM r"""

#: Names in the order of the language, in which the SQL ranks them.
_PLACES = ("Ane", "eik", "Eik", "Zeta", "Ærlig", "Østre", "ås", "Ås", "Aas")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _pick(_PLACES, F.col("o_orderkey") * 5 + F.col("o_custkey")).alias("place"))


def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each customer's orders in the order of the language."""
    w = Window.partitionBy("o_custkey").orderBy(text.in_locale("place"), "o_orderkey")
    return _places(spark, sf_dir).select("o_custkey", F.row_number().over(w).alias("nth"), "place", "o_orderkey")


def preferred_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling that stands for each customer's places."""
    return identity.preferred_spellings(_places(spark, sf_dir), ["o_custkey"], "place")


PLACES_SQL = f"p AS (SELECT o_orderkey, o_custkey, {list(_PLACES)}[CAST((o_orderkey * 5 + o_custkey) % {len(_PLACES)} AS INTEGER) + 1] AS place, (o_orderkey * 5 + o_custkey) % {len(_PLACES)} AS r FROM orders)"
SPELLINGS_SQL = f"""
WITH {PLACES_SQL}, c AS (SELECT o_custkey, place, r, count(*) AS k FROM p GROUP BY ALL)
SELECT o_custkey, arg_min(place, {{'k': -k, 'r': r}}) AS spelling, count(*) AS spellings, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY o_custkey, lower(place)"""

DEFINED = {
    "claims_split": (claims_split, CLAIMS_SPLIT_SQL),
    "compared_names": (compared_names, COMPARED_SQL),
    "parsed_queries": (parsed_queries, PARSED_SQL),
    "club_keys": (club_keys, CLUBS_SQL),
    "encoding_repairs": (encoding_repairs, "SELECT doc_id, coalesce(doc_id % 3 <> 0 AND regexp_matches(text, '[^\\x00-\\x7F]'), FALSE) AS repaired FROM documents"),
    "local_times": (local_times, "SELECT event_id, CAST(t AS DATE) AS day, strftime(t, '%H:%M') AS kickoff FROM (SELECT event_id, (CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 365 AS INTEGER))) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Oslo' AS t FROM events)"),
    "note_hints": (note_hints, NOTE_SQL),
    "noted_competitions": (noted_competitions, NOTED_SQL),
    "remark_classes": (remark_classes, REMARK_SQL),
    "printed_minutes": (printed_minutes, MINUTES_SQL),
    "paper_access": (paper_access, ACCESS_SQL),
    "less_precise_titles": (less_precise_titles, f"WITH {_ROLES} SELECT DISTINCT a.person, a.from_year, a.title, b.title AS beside FROM r a JOIN r b ON a.person = b.person AND a.from_year = b.from_year AND starts_with(lower(b.title), lower(a.title) || ' ')"),
    "old_sources": (old_sources, f"WITH {_ROLES}, e AS (SELECT person, min(from_year) AS earliest FROM r GROUP BY person) SELECT person, source, CAST(from_year - source % 12 AS INTEGER) AS year, earliest FROM r JOIN e USING (person) WHERE from_year - source % 12 < earliest - 5"),
    "other_coaches": (other_coaches, COACHES_SQL),
    "outside_spells": (outside_spells, OUTSIDE_SQL),
    "suspicious_names": (suspicious_names, NAMES_SQL),
    "verification_candidates": (verification_candidates, CANDIDATES_SQL),
    "review_validity": (review_validity, VALIDITY_SQL),
    "claim_integrity": (claim_integrity, INTEGRITY_SQL),
    "documented_years": (documented_years, YEARS_SQL),
    "extra_time": (extra_time, EXTRA_SQL),
    "shootouts": (shootouts, SHOOTOUT_SQL),
    "loose_names": (loose_names, LOOSE_SQL),
    "batch_policies": (batch_policies, "SELECT o_orderkey AS hypothesis, s AS siblings, CASE WHEN s > 1 THEN 'manual' ELSE 'automatic' END AS policy FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS s FROM orders)"),
    "fragment_scores": (fragment_scores, FRAGMENT_SQL),
    "edge_scores": (edge_scores, EDGE_SQL),
    "allocations": (allocations, None),
    "bound_scores": (bound_scores, BOUND_SQL),
    "locale_order": (locale_order, f"WITH {PLACES_SQL} SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY r, o_orderkey) AS INTEGER) AS nth, place, o_orderkey FROM p"),
    "preferred_spellings": (preferred_spellings, SPELLINGS_SQL),
}
