"""Queries on views and audits of several record tables, with records made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ENCOUNTERS_SQL, encounters, table
from ..operators import archive
from .review_queries import TITLES, _pick, _picked, _roles

POSITIONS = ("keeper", "back", "forward")
KINDS = ("clubs", "people", "venues")


def squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").alias("season"), F.col("o_orderdate").cast("date").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("person_key"), F.concat(F.lit("name "), (F.col("l_suppkey") * 10 + F.col("l_linenumber") % 2).cast("string")).alias("name"),
        F.when(F.col("l_returnflag") == "N", "start").otherwise("bench").alias("role"), (F.col("l_quantity") > 45).alias("scored"),
    )
    rows = lines.join(orders, "match_id")
    s = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    register = suppliers.select(F.floor(s / 2).cast("long").alias("person_key"), s.alias("person_id"), _pick(POSITIONS, s).alias("position"))
    numbers = suppliers.select((1992 + s % 7).cast("int").alias("season"), s.alias("person_id"), (s % 99).alias("number"))
    return archive.squad(rows, rows.filter("scored").select("season", "person_key"), register, numbers)


SQUAD_SQL = f"""
WITH r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, l_orderkey, l_suppkey AS person_key, 'name ' || (l_suppkey * 10 + l_linenumber % 2) AS name, l_returnflag = 'N' AS s, CAST(o_orderdate AS DATE) AS d, l_quantity > 45 AS g
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'),
o AS (SELECT season, person_key, l_orderkey, min(name) AS name, bool_or(s) AS s, min(d) AS d FROM r GROUP BY ALL),
a AS (SELECT season, person_key, min(name) AS name, count(*) AS appearances, count(*) FILTER (s) AS starts, min(d) AS first_match, max(d) AS last_match FROM o GROUP BY ALL),
g AS (SELECT season, person_key, count(*) AS goals FROM r WHERE g GROUP BY ALL),
k AS (SELECT s_suppkey // 2 AS person_key, min(s_suppkey) AS person_id FROM supplier GROUP BY ALL)
SELECT a.*, person_id, CASE WHEN person_id IS NOT NULL THEN {_picked(POSITIONS, 'person_id')} END AS position, CASE WHEN 1992 + person_id % 7 = season THEN person_id % 99 END AS number, coalesce(goals, 0) AS goals
FROM a LEFT JOIN k USING (person_key) LEFT JOIN g USING (season, person_key)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    register = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"))
    activity = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("season"))
    roles = _roles(spark, sf_dir).withColumn("category", F.lower(F.substring_index("title", " ", 1)))
    return archive.people(register, activity, roles).withColumn("role_categories", F.array_join("role_categories", ","))


PEOPLE_SQL = f"""
WITH r AS (SELECT o_custkey AS person, lower(split_part({_picked(TITLES, 'o_orderkey')}, ' ', 1)) AS category, CAST(year(o_orderdate) AS INTEGER) AS f, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) + o_orderkey % 4 ELSE year(o_orderdate) END AS INTEGER) AS t FROM orders),
a AS (SELECT o_custkey AS person, CAST(min(year(o_orderdate)) AS INTEGER) AS first_season, CAST(max(year(o_orderdate)) AS INTEGER) AS last_season, count(*) AS appearances FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
h AS (SELECT person, count(*) AS role_count, min(f) AS first_role_year, max(t) AS last_role_year, array_to_string(list_sort(list(DISTINCT category)), ',') AS role_categories FROM r GROUP BY person),
y AS (SELECT person, count(DISTINCT v) AS role_years FROM (SELECT person, unnest(generate_series(f, t)) AS v FROM r) GROUP BY person)
SELECT c_custkey AS person, c_name AS name, first_season, last_season, coalesce(appearances, 0) AS appearances, coalesce(role_count, 0) AS role_count, first_role_year, last_role_year, role_categories, coalesce(role_years, 0) AS role_years
FROM customer LEFT JOIN a ON c_custkey = a.person LEFT JOIN h ON c_custkey = h.person LEFT JOIN y ON c_custkey = y.person"""


def home_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("int")
    span = lambda a, b: F.struct(a.cast("int").alias("from_year"), b.cast("int").alias("to_year"))
    none = F.array().cast("array<struct<from_year:int,to_year:int>>")
    periods = F.when(n % 4 == 0, none).when(n % 4 == 1, F.array(span(1992 + n % 3, F.lit(1993) + n % 3), span(F.lit(1996), F.lit(None)))).otherwise(F.array(span(F.lit(1993), F.lit(1995))))
    venues = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("venue"), periods.alias("periods"))
    return archive.home_venues(venues, encounters(spark, sf_dir).select(F.col("home_id").alias("venue"), "season"))


VENUES_SQL = f"""
WITH {ENCOUNTERS_SQL}
SELECT n_nationkey AS venue, count(match_id) AS matches, count(match_id) FILTER (CASE WHEN n_nationkey % 4 = 1 THEN season BETWEEN 1992 + n_nationkey % 3 AND 1993 + n_nationkey % 3 OR season >= 1996 ELSE season BETWEEN 1993 AND 1995 END) AS home_matches
FROM nation LEFT JOIN encounters ON home_id = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY n_nationkey"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    facts = orders.select(F.col("o_orderkey").alias("fact"), F.col("o_orderdate").cast("date").alias("day"))
    n = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0")
    related = lines.select(F.col("l_orderkey").alias("fact"), _pick(KINDS, n).alias("kind"), (F.col("l_suppkey") % 13).cast("string").alias("ref"))
    cited = lines.select(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("position"), F.when(n % 3 != 0, F.concat(F.lit("/p/"), n.cast("string"))).alias("url"))
    out = archive.observations(facts, related, cited, list(KINDS))
    return out.withColumns({k: F.array_join(k, ",") for k in KINDS})


_RELATED = ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT CAST(l_suppkey % 13 AS VARCHAR)) FILTER ({_picked(KINDS, 'l_partkey')} = '{k}')), ','), '') AS {k}" for k in KINDS)
OBSERVATIONS_SQL = f"""
WITH l AS (SELECT l_orderkey AS fact, {_RELATED}, arg_min('/p/' || l_partkey, {{'n': l_linenumber, 'u': '/p/' || l_partkey}}) FILTER (l_partkey % 3 <> 0) AS first_url FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey)
SELECT o_orderkey AS fact, CAST(o_orderdate AS DATE) AS day, {', '.join(f"coalesce({k}, '') AS {k}" for k in KINDS)}, first_url FROM orders LEFT JOIN l ON o_orderkey = fact"""


def verified_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_partkey")
    fragments = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("issue"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("fragment"), (n % 30).cast("int").alias("evidence"), (n % 4 != 0).alias("same_fragment"),
        F.when(n % 5 < 2, F.concat(F.lit("on "), (n % 7).cast("string"))).alias("phrase"), F.when(n % 6 == 0, F.concat((n % 4).cast("string"), F.lit("-1"))).alias("printed"), (n % 9 == 0).alias("retrospective"),
    )
    return archive.verified_issues(fragments)


ISSUES_SQL = """
WITH f AS (SELECT l_orderkey AS issue, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS fragment, CAST(l_partkey % 30 AS INTEGER) AS evidence, l_partkey % 4 <> 0 AS same,
    CASE WHEN l_partkey % 5 < 2 THEN 'on ' || l_partkey % 7 END AS phrase, CASE WHEN l_partkey % 6 = 0 THEN (l_partkey % 4) || '-1' END AS printed, l_partkey % 9 = 0 AS retro FROM lineitem),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY issue ORDER BY evidence DESC, fragment) = 1),
s AS (SELECT * FROM f WHERE same AND printed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue ORDER BY evidence DESC, fragment) = 1),
d AS (SELECT * FROM f WHERE same AND phrase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue ORDER BY evidence DESC, fragment) = 1)
SELECT a.issue, coalesce(s.fragment, a.fragment) AS fragment, coalesce(s.evidence, a.evidence) AS evidence, coalesce(s.printed, a.printed) AS printed,
  CASE WHEN s.issue IS NOT NULL THEN CASE WHEN NOT s.retro THEN s.phrase END WHEN a.phrase IS NULL THEN d.phrase WHEN NOT a.retro OR a.printed IS NULL THEN a.phrase END AS phrase
FROM a LEFT JOIN s ON a.issue = s.issue LEFT JOIN d ON a.issue = d.issue"""

CANONICAL = ("canonicalized", "existing_match", "none", "none", "none", "none")
REVIEWS = ("stale_review", "never_reviewed", "superseded_review", "current", "current", "current", "current")
COMMUNITY = ("published", "unresolved", "none", "none", "none")
RESOLUTIONS = ("different_event", "non_senior", "insufficient", "probable")


def closure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    facts = [
        o.filter(k % 7 != 0).select(k.alias("claim"), _pick(CANONICAL, k).alias("canonical")),
        o.filter(k % 11 != 0).select(k.alias("claim"), (c % 10 != 0).alias("has_candidates")),
        o.filter(k % 13 != 0).select(k.alias("claim"), _pick(REVIEWS, c).alias("review"), _pick(RESOLUTIONS, F.floor(c / 7)).alias("resolution"), F.when(c % 3 == 0, "ready").alias("eligibility")),
        o.select(k.alias("claim"), _pick(COMMUNITY, F.floor(k / 6)).alias("community")),
    ]
    return archive.closure(o.select(k.alias("claim")), *facts)


CLOSURE_SQL = f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN k % 7 <> 0 THEN {_picked(CANONICAL, 'k')} ELSE '' END AS canonical, k % 11 <> 0 AND c % 10 <> 0 AS found, CASE WHEN k % 13 <> 0 THEN {_picked(REVIEWS, 'c')} ELSE 'never_reviewed' END AS review,
  {_picked(COMMUNITY, '(k // 6)')} AS community, {_picked(RESOLUTIONS, '(c // 7)')} AS resolution FROM orders),
w AS (SELECT k AS claim, CASE WHEN canonical = 'canonicalized' THEN 'canonicalized' WHEN canonical = 'existing_match' THEN 'matched_existing_canonical' WHEN NOT found THEN 'no_candidate' WHEN review = 'stale_review' THEN 'requires_revalidation'
  WHEN community <> 'none' THEN 'community_research' WHEN review <> 'current' THEN 'needs_visual_review' WHEN resolution = 'different_event' THEN 'rejected_different_event' WHEN resolution = 'non_senior' THEN 'rejected_non_senior'
  WHEN c % 3 = 0 THEN 'ready_for_canonicalization' WHEN resolution = 'insufficient' THEN 'candidate_exhausted' ELSE 'visually_reviewed_unresolved' END AS workflow FROM o)
SELECT *, CASE WHEN workflow NOT IN {archive.OPEN} THEN workflow END AS terminal FROM w"""


def generated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_partkey")
    candidates = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"), F.when(n % 19 != 0, n % 40).alias("candidate"), F.concat_ws("/", (F.col("l_orderkey") % 500).cast("string"), (F.col("l_suppkey") % 3).cast("string")).alias("target"),
        F.when(n % 6 != 0, n % 6 != 1).alias("reviewable"),
    )
    existing = table(spark, sf_dir, "customer").filter("c_custkey < 500 AND c_custkey % 4 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit("/1")).alias("target"))
    return archive.generated_cases(candidates, existing)


CASES_SQL = """
WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row, CASE WHEN l_partkey % 19 <> 0 THEN l_partkey % 40 END AS candidate, (l_orderkey % 500) || '/' || (l_suppkey % 3) AS target, l_partkey % 6 > 1 AS usable FROM lineitem),
n AS (SELECT *, min(row) FILTER (usable) OVER (PARTITION BY candidate, target) AS first FROM c)
SELECT row, candidate, target, CASE WHEN NOT usable THEN 'not_reviewable' WHEN row <> first THEN 'duplicate' WHEN target IN (SELECT c_custkey || '/1' FROM customer WHERE c_custkey < 500 AND c_custkey % 4 = 0) THEN 'manual_case_exists' ELSE 'created' END AS state FROM n"""


def uncovered_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda c: F.when(c % 3 != 0, c % 5)
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 50).alias("source"), page(F.col("l_orderkey")).alias("page"))
    observed = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("person"), (F.col("o_orderkey") % 50).alias("source"), page(F.col("o_custkey")).alias("page"))
    return archive.uncovered_mentions(mentions, observed).groupBy("person", "source", "page").agg(F.count("*").alias("n"))


MENTIONS_SQL = """
WITH m AS (SELECT l_suppkey AS person, l_partkey % 50 AS source, CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey % 5 END AS page, count(*) AS n FROM lineitem GROUP BY ALL),
o AS (SELECT DISTINCT o_custkey % 100 AS person, o_orderkey % 50 AS source, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 5 END AS page FROM orders)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.person = m.person AND o.source = m.source AND o.page IS NOT DISTINCT FROM m.page)"""


def moved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    old = o.select(k.alias("coordinate"), F.when(c % 9 != 0, c).alias("payload"))
    new = o.filter(k % 71 != 0).select((-k).alias("coordinate"), F.when(c % 9 != 0, F.when(k % 61 == 0, c + 1).otherwise(c)).alias("payload"))
    moves = o.filter(k % 53 != 0).select(F.when(k % 67 == 0, k + 100000000).otherwise(k).alias("origin"), (-k).alias("target"))
    again = o.filter(k % 59 == 0).select(k.alias("origin"), F.lit(-1).cast("long").alias("target"))
    return archive.moved(old, new, moves.unionByName(again))


MOVED_SQL = """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS p FROM orders), n AS (SELECT -k AS k, CASE WHEN k % 61 = 0 THEN p + 1 ELSE p END AS p FROM o WHERE k % 71 <> 0),
m AS (SELECT CASE WHEN k % 67 = 0 THEN k + 100000000 ELSE k END AS a, -k AS b FROM o WHERE k % 53 <> 0 UNION ALL SELECT k, -1 FROM o WHERE k % 59 = 0)
SELECT fault, CAST(x AS VARCHAR) AS about FROM (
  SELECT 'origin_twice' AS fault, a AS x FROM m GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'target_twice', b FROM m GROUP BY b HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'origin_unknown', a FROM m WHERE a NOT IN (SELECT k FROM o) UNION ALL SELECT DISTINCT 'target_unknown', b FROM m WHERE b NOT IN (SELECT k FROM n)
  UNION ALL SELECT 'not_moved', k FROM o WHERE k NOT IN (SELECT a FROM m) UNION ALL SELECT 'not_explained', k FROM n WHERE k NOT IN (SELECT b FROM m)
  UNION ALL SELECT 'payload_changed', a FROM m JOIN o ON a = o.k JOIN n ON b = n.k WHERE o.p IS DISTINCT FROM n.p)"""


def filled_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    register = table(spark, sf_dir, "customer").select(c.alias("person"), F.when(c % 3 != 0, c % 4).alias("country"), F.when(c % 2 == 0, F.col("c_mktsegment")).alias("position"))
    k = F.col("o_custkey")
    found = table(spark, sf_dir, "orders").select(k.alias("person"), F.col("o_orderkey").alias("seen"), F.when(F.col("o_orderkey") % 3 != 0, k % 8).alias("country"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("position"))
    return archive.filled_profiles(register, found, "person", ["country", "position"], "seen").withColumn("conflicts", F.array_join("conflicts", ","))


PROFILES_SQL = """
WITH f AS (SELECT o_custkey AS person, min(o_custkey % 8) FILTER (o_orderkey % 3 <> 0) AS country, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS position FROM orders GROUP BY o_custkey),
r AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS country, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS position FROM customer)
SELECT r.person, coalesce(r.country, f.country) AS country, coalesce(r.position, f.position) AS position, concat_ws(',', CASE WHEN r.country <> f.country THEN 'country' END, CASE WHEN r.position <> f.position THEN 'position' END) AS conflicts
FROM r LEFT JOIN f USING (person)"""

DEFINED = {
    "squad": (squad, SQUAD_SQL),
    "people": (people, PEOPLE_SQL),
    "home_venues": (home_venues, VENUES_SQL),
    "historical_observations": (observations, OBSERVATIONS_SQL),
    "verified_issues": (verified_issues, ISSUES_SQL),
    "closure_ledger": (closure_ledger, CLOSURE_SQL),
    "generated_cases": (generated_cases, CASES_SQL),
    "uncovered_mentions": (uncovered_mentions, MENTIONS_SQL),
    "moved_claims": (moved_claims, MOVED_SQL),
    "filled_profiles": (filled_profiles, PROFILES_SQL),
}
