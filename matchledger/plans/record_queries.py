"""Queries on evidence layers, conflicts, validation, identity, texts, evidence, provenance and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ENCOUNTERS_SQL, FOCAL, MATCHES_SQL, encounters, table
from ..functions import dates, text
from ..operators import evidence, identity, layers, mentions, provenance, search, validate, views
from ..streaming import limits

COUNTED_SQL = "status IN ('played', 'awarded')"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.perspective(encounters(spark, sf_dir, FOCAL), FOCAL)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled encounters as claims of several sources: season, opponent, stated difference and source."""
    rows = _matches(spark, sf_dir).filter("status = 'scheduled'")
    return rows.select(F.col("match_id").alias("claim_id"), "season", "competition", "opponent_id", "match_date", "goal_difference", F.concat(F.lit("s"), (F.col("own_score") % 3).cast("string")).alias("source"))


CLAIMS_SQL = f"""{MATCHES_SQL},
claims AS (SELECT match_id AS claim_id, season, competition, opponent_id, match_date, goal_difference, 's' || CAST(own_score % 3 AS VARCHAR) AS source
           FROM matches WHERE status = 'scheduled')"""


def union_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["match_id", "season", "opponent_id", "goal_difference", "match_date"]
    canonical = _matches(spark, sf_dir).filter(views.counted())
    claims = _claims(spark, sf_dir).withColumnRenamed("claim_id", "match_id")
    return layers.with_levels(canonical, claims, columns, 100, [F.desc("goal_difference"), F.desc("match_date"), "match_id"])


def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.grouped_claims(_claims(spark, sf_dir), ["season", "opponent_id", "competition"], "goal_difference")


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of canonical matches and, apart from them, of claim groups."""
    m, c = _matches(spark, sf_dir), _claims(spark, sf_dir)
    canonical = m.filter(views.counted()).groupBy("opponent_id").agg(F.count("*").alias("played"), F.count_if(F.col("result") == "S").alias("wins"))
    groups = layers.grouped_claims(c, ["opponent_id", "season", "competition"], "goal_difference")
    unlinked = groups.groupBy("opponent_id").agg(F.count("*").alias("unlinked_groups"), F.sum("claims").alias("unlinked_claims"), F.count_if(F.col("agreed") > 0).alias("unlinked_wins"))
    out = canonical.join(unlinked, "opponent_id", "full_outer")
    return out.select("opponent_id", *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("played", "wins", "unlinked_groups", "unlinked_claims", "unlinked_wins")))


GROUPS_SQL = """
groups AS (SELECT season, opponent_id, competition, CASE WHEN count(DISTINCT goal_difference) = 1 THEN max(goal_difference) END AS agreed,
             count(*) AS claims, count(DISTINCT goal_difference) AS "values", string_agg(DISTINCT source, ',' ORDER BY source) AS sources
           FROM claims GROUP BY ALL)"""


def preferred_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of part names: every third has an accent, every fifth is in capitals."""
    p = table(spark, sf_dir, "part")
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit("e"), F.lit("é"))).when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return layers.preferred_spelling(p.select(F.col("p_name").alias("key"), spelled.alias("name")), "key", "name")


SPELLING_SQL = """
WITH s AS (SELECT p_name AS key, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'é') WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
c AS (SELECT key, name, count(*) AS n FROM s GROUP BY ALL)
SELECT key, name AS preferred, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY regexp_matches(name, '[^\\x00-\\x7F]') DESC, n DESC, name) = 1"""


def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated labels against labels derived from the text's length, one row per value, the stated one chosen."""
    stated = table(spark, sf_dir, "labels").select("doc_id", F.lit("quality").alias("field"), F.col("quality").alias("value"), F.lit(0).alias("source"))
    derived = table(spark, sf_dir, "documents").select("doc_id", F.lit("quality").alias("field"), (F.length("text") >= 800).cast("int").alias("value"), F.lit(1).alias("source"))
    rows = stated.unionByName(derived.join(stated.select("doc_id"), "doc_id", "left_semi"))
    found = layers.conflicts(rows.groupBy("doc_id", "field", "value").agg(F.min("source").alias("source")), ["doc_id"], "field", "value")
    sources = rows.groupBy("doc_id", "field", "value").agg(F.min("source").alias("source"))
    return layers.decided(found.join(sources, ["doc_id", "field", "value"]), ["doc_id"], "field", "value", ["source"]).select("doc_id", "field", "value", "is_chosen")


CONFLICT_SQL = """
WITH r AS (SELECT doc_id, quality AS value, 0 AS source FROM labels
           UNION ALL SELECT doc_id, CAST(length(text) >= 800 AS INTEGER), 1 FROM documents SEMI JOIN labels USING (doc_id)),
g AS (SELECT doc_id, value, min(source) AS source FROM r WHERE value IS NOT NULL GROUP BY ALL)
SELECT doc_id, 'quality' AS field, CAST(value AS INTEGER) AS value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source, value) = 1 AS INTEGER) AS is_chosen
FROM g QUALIFY count(*) OVER (PARTITION BY doc_id) > 1"""


def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that sources label with different languages."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), F.lit("source").alias("field"), F.col("source").alias("value"))
    return layers.conflicts(rows, ["content"], "field", "value")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, duplicates, group consistency and constraints over the tables; faults come from shifted keys."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    odd = orders.withColumn("customer", F.when(F.col("o_orderkey") % 97 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    rules = {"price": F.col("o_totalprice") < 400000, "status": F.col("o_orderstatus").isin("F", "O", "P"), "priority": F.col("o_orderpriority").rlike("^[1-5]-")}
    return validate.together(
        validate.references(odd, "o_orderkey", "customer", table(spark, sf_dir, "customer"), "c_custkey"),
        validate.duplicates(lines, "l_orderkey", "l_linenumber"),
        validate.consistent(lines.withColumn("mode", F.col("l_returnflag")), "l_orderkey", "mode", "l_linestatus"),
        validate.constraints(orders, "o_orderkey", rules),
    )


ISSUES_SQL = """
SELECT 'reference' AS "check", CAST(o_orderkey AS VARCHAR) AS key, 'customer -' || CAST(o_custkey AS VARCHAR) AS message FROM orders WHERE o_orderkey % 97 = 0 AND o_custkey > 0
UNION ALL SELECT 'duplicate', l_orderkey || '-' || l_linenumber, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'group', CAST(l_orderkey AS VARCHAR), 'mode' FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1
UNION ALL SELECT 'group', CAST(l_orderkey AS VARCHAR), 'l_linestatus' FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1
UNION ALL SELECT 'constraint', CAST(o_orderkey AS VARCHAR), 'price' FROM orders WHERE NOT o_totalprice < 400000
UNION ALL SELECT 'constraint', CAST(o_orderkey AS VARCHAR), 'status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')
UNION ALL SELECT 'constraint', CAST(o_orderkey AS VARCHAR), 'priority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')"""


def sequence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.sequence(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


SEQUENCE_SQL = """
SELECT 'sequence' AS "check", CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS message FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem) WHERE l_linenumber <> nth"""


def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written in four ways, looked up by alias, then by name, then by the name's start."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    asked = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("id")).select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("N"), F.col("id").cast("string"))).when(F.col("c_custkey") % 4 == 1, F.col("n_name")).when(F.col("c_custkey") % 4 == 2, F.lower("n_name")).otherwise(F.lit("?")).alias("said"),
    )
    asked = asked.withColumns({"low": F.lower("said"), "start": F.substring(F.lower("said"), 1, 3)})
    levels = [
        ("alias", "said", names.select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("form"), "id")),
        ("exact", "said", names.select(F.col("n_name").alias("form"), "id")),
        ("folded", "low", names.select(F.lower("n_name").alias("form"), "id")),
        ("start", "start", names.select(F.substring(F.lower("n_name"), 1, 3).alias("form"), "id")),
    ]
    return identity.cascade(asked, "c_custkey", levels).select("c_custkey", "found", "level")


CASCADE_SQL = """
WITH n AS (SELECT n_nationkey AS id, n_name FROM nation),
a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'N' || id WHEN 1 THEN n_name WHEN 2 THEN lower(n_name) ELSE '?' END AS said FROM customer JOIN n ON c_nationkey = id),
h AS (SELECT c_custkey, 0 AS rank, 'alias' AS level, id FROM a JOIN n ON said = 'N' || id
  UNION ALL SELECT c_custkey, 1, 'exact', id FROM a JOIN n ON said = n_name
  UNION ALL SELECT c_custkey, 2, 'folded', id FROM a JOIN n ON lower(said) = lower(n_name)
  UNION ALL SELECT c_custkey, 3, 'start', id FROM a JOIN n ON substr(lower(said), 1, 3) = substr(lower(n_name), 1, 3)),
e AS (SELECT c_custkey, rank, level, count(DISTINCT id) AS ids, min(id) AS id FROM h GROUP BY ALL),
g AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank) = 1)
SELECT c_custkey, CASE WHEN ids = 1 THEN id END AS found, CASE WHEN ids = 1 THEN level WHEN ids > 1 THEN 'ambiguous' ELSE 'none' END AS level FROM a LEFT JOIN g USING (c_custkey)"""


def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all customers and parts within one edit."""
    return identity.near_names(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))), "name", 1)


def near_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with their brands within two edits."""
    return identity.near_names(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")), "name", 2)


NEAR_SQL = """
WITH n AS (SELECT DISTINCT c_name AS n FROM customer UNION SELECT DISTINCT p_name FROM part)
SELECT x.n AS a, y.n AS b, CAST(levenshtein(x.n, y.n) AS INTEGER) AS edits FROM n x JOIN n y ON x.n < y.n AND abs(length(x.n) - length(y.n)) <= 1 WHERE levenshtein(x.n, y.n) <= 1"""

NEAR_BRANDS_SQL = """
WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS n FROM part)
SELECT x.n AS a, y.n AS b, CAST(levenshtein(x.n, y.n) AS INTEGER) AS edits FROM n x JOIN n y ON x.n < y.n AND abs(length(x.n) - length(y.n)) <= 2 WHERE levenshtein(x.n, y.n) <= 2"""


def token_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    longer = short.withColumn("more", F.explode(F.array(F.lit("africa"), F.lit("large red")))).select(F.concat_ws(" ", "name", "more").alias("name"))
    return identity.token_subsets(short.unionByName(longer), "name")


SUBSET_SQL = """
WITH p AS (SELECT DISTINCT p_name AS n FROM part), n AS (SELECT n FROM p UNION SELECT n || ' africa' FROM p UNION SELECT n || ' large red' FROM p),
w AS (SELECT n, list_distinct(string_split(n, ' ')) AS w FROM n)
SELECT a.n AS shorter, b.n AS longer FROM w a JOIN w b ON len(a.w) >= 2 AND len(a.w) < len(b.w) AND list_has_all(b.w, a.w)"""


def prefix_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("key"))
    longer = p.withColumn("key", F.concat_ws("-", "key", F.lit("x"))).unionByName(p.withColumn("key", F.concat_ws("-", "key", F.lit("2"))))
    return identity.prefix_extensions(p.unionByName(longer), "key")


PREFIX_SQL = """
WITH p AS (SELECT DISTINCT replace(p_name, ' ', '-') AS k FROM part), n AS (SELECT k FROM p UNION SELECT k || '-x' FROM p UNION SELECT k || '-2' FROM p)
SELECT a.k AS shorter, b.k AS longer FROM n a JOIN n b ON starts_with(b.k, a.k || '-') WHERE NOT regexp_matches(substr(b.k, length(a.k) + 2), '^[0-9]+$')"""


def name_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names at the dates of their orders: a former name up to 1994, the present one after 1996."""
    c = table(spark, sf_dir, "customer")
    spans = F.array(F.struct(F.concat(F.lit("old "), F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("from"), F.lit("1994-12-31").alias("to")), F.struct(F.concat(F.lit("new "), F.col("c_name")).alias("name"), F.lit("1997-01-01").alias("from"), F.lit(None).cast("string").alias("to")))
    rows = table(spark, sf_dir, "orders").join(c.withColumn("names", spans), F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return rows.select("o_orderkey", identity.name_as_of(F.col("names"), F.col("c_name"), day).alias("name"))


AS_OF_SQL = """
SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') <= '1994-12-31' THEN 'old ' || c_name WHEN strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01' THEN 'new ' || c_name ELSE c_name END AS name
FROM orders JOIN customer ON o_custkey = c_custkey"""


def nearest_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's nearest view, up to three days before or after."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    left, right = e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'")
    return identity.nearest(left.select(F.col("event_id"), "user_id", "ts"), right.select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("seen")), "user_id", "ts", "seen", "event_id", "view_id", 3, 3)


NEAREST_SQL = """
WITH l AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
r AS (SELECT min(event_id) AS match, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE))
SELECT event_id, match, CAST(r.d - l.d AS INTEGER) AS days FROM l JOIN r ON l.user_id = r.user_id AND abs(r.d - l.d) <= 3
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(r.d - l.d), r.d - l.d, match) = 1"""


def interval_stabbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose span of orders holds a year."""
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("since"), F.max(F.year("o_orderdate")).alias("until"))
    return spans.filter(dates.covers(F.col("since"), F.col("until"), F.lit(1995)))


def year_span_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("since"), F.max(F.year("o_orderdate")).alias("until"))
    return spans.select("o_custkey", F.explode(dates.year_span(F.col("since"), F.col("until"))).alias("year"))


def singular_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as offices that one customer of a nation holds for the span of their orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("since"), F.max(F.year("o_orderdate")).alias("until"))
    rows = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("office", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return provenance.holders(rows, "office", "c_custkey", "since", "until")


HOLDERS_SQL = """
WITH o AS (SELECT o_custkey, min(year(o_orderdate)) AS s, max(year(o_orderdate)) AS e FROM orders GROUP BY o_custkey),
r AS (SELECT c_mktsegment || '/' || c_nationkey AS office, c_custkey, s, e FROM o JOIN customer ON o_custkey = c_custkey),
y AS (SELECT office, c_custkey, s, e, y FROM r, unnest(range(CAST(s AS BIGINT), CAST(e + 1 AS BIGINT))) AS u(y)),
g AS (SELECT office, y, count(DISTINCT c_custkey) AS holders, count(*) FILTER (e = y) AS ending, count(*) FILTER (s = y) AS starting FROM y GROUP BY ALL)
SELECT office, CAST(y AS INTEGER) AS year, holders FROM g WHERE holders > 1 AND NOT (holders = 2 AND ending >= 1 AND starting >= 1)"""


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.links(F.col("html"))).alias("nth", "target"))
    return rows


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^(https?)://", 1).alias("scheme"), F.regexp_extract(url, "^https?://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1).alias("path"), F.sha2(url, 256).alias("cache_key"))


URL_SQL = """
SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
       regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, sha256(url) AS cache_key FROM pages"""


def fulltext_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_all(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["the", "thing"]).select("doc_id")


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its document count and its occurrences."""
    rows = search.index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))


INDEX_SQL = """
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS n FROM w GROUP BY term"""


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return search.ranked(p, F.col("p_name"), "blue", "p_name", 50)


RANKED_SQL = """
SELECT p_name, CAST(CASE WHEN lower(p_name) = 'blue' THEN 0 WHEN starts_with(lower(p_name), 'blue') THEN 1 ELSE 2 END AS INTEGER) AS tier
FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'blue') ORDER BY tier, p_name LIMIT 50"""


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as a dictionary of whole phrases, found in documents by an automaton: how often each document holds which."""
    phrases = table(spark, sf_dir, "benchmark").select(F.lit("passage").alias("kind"), F.col("item_id").cast("string").alias("ref"), F.col("text").alias("form"))
    hits = mentions.term_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", phrases)
    return hits.groupBy("doc_id", F.col("ref").cast("long").alias("item_id")).agg(F.count("*").alias("hits"), F.min("at").alias("first"))


PHRASE_SQL = """
WITH f AS (SELECT doc_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9æø]+', ' ', 'g'), ' ') || ' ' AS t FROM documents),
b AS (SELECT DISTINCT item_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9æø]+', ' ', 'g'), ' ') || ' ' AS p FROM benchmark WHERE text IS NOT NULL)
SELECT doc_id, item_id, len(list_filter(range(1, CAST(length(t) - length(p) + 2 AS BIGINT)), lambda i: substr(t, i, length(p)) = p)) AS hits, CAST(instr(t, p) - 1 AS INTEGER) AS first
FROM b JOIN f ON contains(t, p) WHERE length(p) > 2"""


def whole_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.whole_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


WHOLE_SQL = """
WITH d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
SELECT doc_id, item_id FROM b JOIN d ON contains(t, ' ' || array_to_string(w, ' ') || ' ') WHERE len(w) >= 1"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shared_runs(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 8)


def two_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", F.sha2("window", 256).alias("window_sha256"))


TWO_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, sha256(ls[i] || chr(10) || ls[i + 1]) AS window_sha256 FROM l, unnest(range(1, CAST(len(ls) AS BIGINT))) AS u(i)"""


def genre_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", search.kind(F.col("text")).alias("kind"))


GENRE_SQL = """
WITH d AS (SELECT doc_id, greatest(length(text), 1) AS n, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
             length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, '.', '')) AS stops FROM documents)
SELECT doc_id, CASE WHEN bars >= 3 THEN 'table' WHEN digits / n > 0.2 THEN 'result_list' WHEN stops >= 3 AND n >= 200 THEN 'article' WHEN n < 80 THEN 'notice' ELSE 'other' END AS kind FROM d"""


def score_like_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(search.printed_scores(F.col("text"))).alias("nth", "score"))
    return rows.select("doc_id", "nth", "score.home", "score.away")


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"), (F.col("doc_id") % 11 == 0).alias("exact"), "lang")
    score = evidence.weighted([(F.col("n") > 500, 20), (F.col("exact"), 25), (F.col("lang") == "en", 15), (F.col("n") < 60, -20)])
    return d.select("doc_id", "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("day"), "exact", score.alias("score"), F.when(F.col("n") > 2000, "high").when(F.col("n") > 500, "medium").otherwise("low").alias("confidence"))


FRAGMENTS_SQL = """
f AS (SELECT doc_id, source, DATE '2024-01-01' + CAST(doc_id % 40 AS INTEGER) AS day, doc_id % 11 = 0 AS exact,
        CAST(CASE WHEN length(text) > 500 THEN 20 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 25 ELSE 0 END + CASE WHEN lang = 'en' THEN 15 ELSE 0 END
          + CASE WHEN length(text) < 60 THEN -20 ELSE 0 END AS INTEGER) AS score,
        CASE WHEN length(text) > 2000 THEN 'high' WHEN length(text) > 500 THEN 'medium' ELSE 'low' END AS confidence FROM documents)"""


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir).select("doc_id", "score", "confidence")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a source in clusters with gaps over one day, and each cluster's scores."""
    rows = evidence.clustered(_fragments(spark, sf_dir), "source", "day", "doc_id", 1)
    return evidence.rank_discounted(rows, ["source", "cluster"], "score", "doc_id")


CLUSTER_SQL = f"""
WITH {FRAGMENTS_SQL},
g AS (SELECT *, CASE WHEN lag(day) OVER w IS NULL OR day - lag(day) OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY source ORDER BY day, doc_id)),
c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY source ORDER BY day, doc_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source, cluster ORDER BY score DESC, doc_id) - 1 AS i FROM c)
SELECT source, cluster, round(sum(score / CASE WHEN i = 0 THEN 1 ELSE i + 3 END), 6) AS event_score, round(sum(CASE WHEN i < 3 THEN score / (i + 1) END), 6) AS combined, count(*) AS items
FROM r GROUP BY source, cluster"""


def voted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.voted_dates(_fragments(spark, sf_dir), "source", "day", "confidence", "score")


VOTED_SQL = f"""
WITH {FRAGMENTS_SQL},
w AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS k FROM f),
v AS (SELECT source, day, CAST(sum(k * greatest(1, score)) AS BIGINT) AS weight, max(k) AS best, count(*) AS votes FROM w GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY source) - 1 AS others, row_number() OVER (PARTITION BY source ORDER BY weight DESC, day) AS nth FROM v)
SELECT source, day, weight, votes, CASE WHEN votes > 1 AND best > 1 OR best = 3 THEN 'high' WHEN best = 2 THEN 'medium' ELSE 'low' END AS confidence, CAST(others AS INTEGER) AS others FROM n WHERE nth = 1"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a hypothesis: what its two best days allow to say."""
    days = _fragments(spark, sf_dir).groupBy("source", "day").agg(F.max("score").alias("score"), F.max(F.col("exact").cast("int")).alias("exact"))
    best = F.sort_array(F.collect_list(F.struct("score", "exact", "day")), asc=False)
    rows = days.groupBy("source").agg(best.alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return rows.select("source", first["score"].alias("best"), evidence.decision(first["score"], second["score"], first["exact"] == 1, F.lit(False)).alias("decision"))


DECISION_SQL = f"""
WITH {FRAGMENTS_SQL},
d AS (SELECT source, day, max(score) AS score, max(CAST(exact AS INTEGER)) AS exact FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, exact DESC, day DESC) AS nth FROM d),
p AS (SELECT source, max(score) FILTER (nth = 1) AS best, max(score) FILTER (nth = 2) AS second, max(exact) FILTER (nth = 1) AS exact FROM r GROUP BY source)
SELECT source, CAST(best AS INTEGER) AS best, CASE WHEN best IS NULL OR best < 45 THEN 'not_found' WHEN second IS NOT NULL AND best - second < 15 THEN 'ambiguous' WHEN exact = 1 THEN 'confirmed' ELSE 'probable' END AS decision FROM p"""


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned lines of each order as claims on its lines, by how close quantity and day are."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("grp"), F.col("l_linenumber").cast("string").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_shipdate").cast("date").alias("d"), "l_returnflag")
    claims = lines.filter("l_returnflag = 'R'").select("grp", F.col("n").alias("hypothesis"), ((F.col("q") * 3) % 50).alias("claimed"), F.date_add("d", 9).alias("day"))
    score = 60 - F.abs(F.col("claimed") - F.col("q")) - F.floor(F.abs(F.datediff("day", "d")) / 3)
    return evidence.assigned(claims.join(lines, "grp").select("grp", "hypothesis", F.col("n").alias("event"), score.alias("score")))


def _heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as two snapshots: some removed, added, changed, or with a null filled."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_custkey")
    head = o.filter(F.col("o_orderkey") % 50 != 1).withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 29 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(F.col("o_orderkey") % 26 == 0, "filled").otherwise(F.col("o_orderpriority"))})
    return o.filter(F.col("o_orderkey") % 40 != 3), head


HEADS_SQL = """
o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS o_orderpriority, o_custkey FROM orders),
base AS (SELECT * FROM o WHERE o_orderkey % 40 <> 3),
head AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 26 = 0 THEN 'filled' ELSE o_orderpriority END AS o_orderpriority, o_custkey FROM o WHERE o_orderkey % 50 <> 1)"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.compared(*_heads(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


DIFF_SQL = f"""
WITH {HEADS_SQL}
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
       WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
       CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END), '') END AS fields
FROM base a FULL JOIN head b ON a.o_orderkey = b.o_orderkey"""


def additive_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _heads(spark, sf_dir)
    approved = base.filter(F.col("o_orderkey") % 58 == 0).select("o_orderkey", F.lit("o_orderstatus").alias("field"))
    return provenance.additive(base, head, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], approved)


AUDIT_SQL = f"""
WITH {HEADS_SQL},
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS fresh, a.o_orderstatus AS s0, b.o_orderstatus AS s1, a.o_orderpriority AS p0, b.o_orderpriority AS p1
      FROM base a FULL JOIN head b ON a.o_orderkey = b.o_orderkey),
f AS (SELECT o_orderkey, 'o_orderstatus' AS field, fresh, s0 AS v0, s1 AS v1 FROM j UNION ALL SELECT o_orderkey, 'o_orderpriority', fresh, p0, p1 FROM j),
t AS (SELECT o_orderkey, field, CASE WHEN fresh THEN 'ADDITION' WHEN v0 IS NOT DISTINCT FROM v1 THEN 'UNCHANGED' WHEN v0 IS NULL THEN 'SAFE_ENRICHMENT'
        WHEN field = 'o_orderstatus' AND o_orderkey % 58 = 0 THEN 'APPROVED_EXCEPTION' ELSE 'DESTRUCTIVE_CHANGE' END AS status FROM f)
SELECT * FROM t WHERE status <> 'UNCHANGED'"""


def payload_hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = s.withColumn("s_name", F.when(F.col("s_suppkey") % 7 == 0, F.upper("s_name")).otherwise(F.col("s_name"))).withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 == 0, None).otherwise(F.col("s_nationkey")))
    return provenance.changed_payloads(s.filter(F.col("s_suppkey") % 9 != 0), new, "s_suppkey", "s_name", "s_nationkey")


HASH_SQL = """
WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 10 <> 0 THEN s_nationkey END AS s_nationkey FROM supplier),
h AS (SELECT s_suppkey, sha256('s_name=s:' || s_name || '|s_nationkey=' || coalesce('s:' || s_nationkey, 'n')) AS payload_hash FROM n),
o AS (SELECT s_suppkey, sha256('s_name=s:' || s_name || '|s_nationkey=s:' || s_nationkey) AS was FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT s_suppkey, payload_hash, CASE WHEN was IS NULL THEN 'create' ELSE 'update' END AS action FROM h LEFT JOIN o USING (s_suppkey) WHERE payload_hash IS DISTINCT FROM was"""


def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations merged from a fresh source; fields set by hand stay."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    old = n.filter("n_nationkey < 20").withColumn("manual", F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("n_name"))).otherwise(F.array().cast("array<string>")))
    new = n.filter("n_nationkey > 2").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.lower("n_name")).alias("n_name"), "n_regionkey")
    return layers.merged(old, new, "n_nationkey", ["n_name", "n_regionkey"], "manual")


FIELD_MERGE_SQL = """
WITH o AS (SELECT *, n_nationkey % 4 = 0 AS manual FROM nation WHERE n_nationkey < 20),
w AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) END AS n_name, n_regionkey FROM nation WHERE n_nationkey > 2),
m AS (SELECT coalesce(o.n_nationkey, w.n_nationkey) AS n_nationkey, o.n_nationkey IS NULL AS fresh, w.n_nationkey IS NULL AS gone, o.n_name AS was,
        CASE WHEN o.manual THEN o.n_name ELSE coalesce(w.n_name, o.n_name) END AS n_name, coalesce(w.n_regionkey, o.n_regionkey) AS n_regionkey
      FROM o FULL JOIN w ON o.n_nationkey = w.n_nationkey)
SELECT n_nationkey, n_name, n_regionkey, CASE WHEN gone THEN 'keep' WHEN fresh THEN 'create' WHEN n_name IS DISTINCT FROM was THEN 'update' ELSE 'skip' END AS action FROM m"""


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks: dict[str, tuple[Column, int]] = {"text": (F.length("text") > 100, 3), "quality": (F.col("quality").isNotNull(), 1), "toxic": (F.col("toxic").isNotNull(), 2), "language": (F.col("lang") == "en", 2)}
    share, missing = provenance.completeness(checks)
    return rows.select("doc_id", share.alias("completeness"), F.array_join(missing, ",").alias("missing"))


COMPLETE_SQL = """
SELECT doc_id, round((CASE WHEN length(text) > 100 THEN 3 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN lang = 'en' THEN 2 ELSE 0 END) / 8, 2) AS completeness,
  concat_ws(',', CASE WHEN NOT length(text) > 100 THEN 'text' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN lang <> 'en' THEN 'language' END) AS missing
FROM documents LEFT JOIN labels USING (doc_id)"""


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.limited(table(spark, sf_dir, "events"), 2, 6 * 3600.0).select("event_id", "allowed")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.counted(table(spark, sf_dir, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = limits.sessions(table(spark, sf_dir, "events"), "6 hours")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SESSIONS_SQL = """
WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM s),
g AS (SELECT user_id, part, count(*) AS n FROM n GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY user_id"""


def latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type, the table taken as a log and a batch that overlap."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return limits.upserted(e.filter("event_id % 3 <> 0 OR event_id % 2 = 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], "ts")


LATEST_SQL = """
SELECT user_id, event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, value DESC) = 1"""

DEFINED = {
    "top_rankings_union_levels": (union_levels, f"WITH {CLAIMS_SQL} SELECT * FROM (SELECT match_id, season, opponent_id, goal_difference, match_date, 'canonical' AS evidence_level FROM matches WHERE {COUNTED_SQL} UNION ALL SELECT claim_id, season, opponent_id, goal_difference, match_date, 'unlinked_claim' FROM claims) ORDER BY goal_difference DESC, match_date DESC, match_id LIMIT 100"),
    "claim_groups": (claim_groups, f"WITH {CLAIMS_SQL}, {GROUPS_SQL} SELECT * FROM groups"),
    "head_to_head_layers": (head_to_head, f"WITH {CLAIMS_SQL}, {GROUPS_SQL}, c AS (SELECT opponent_id, count(*) AS played, count(*) FILTER (result = 'S') AS wins FROM matches WHERE {COUNTED_SQL} GROUP BY opponent_id), u AS (SELECT opponent_id, count(*) AS unlinked_groups, CAST(sum(claims) AS BIGINT) AS unlinked_claims, count(*) FILTER (agreed > 0) AS unlinked_wins FROM groups GROUP BY opponent_id) SELECT coalesce(c.opponent_id, u.opponent_id) AS opponent_id, coalesce(played, 0) AS played, coalesce(wins, 0) AS wins, coalesce(unlinked_groups, 0) AS unlinked_groups, coalesce(unlinked_claims, 0) AS unlinked_claims, coalesce(unlinked_wins, 0) AS unlinked_wins FROM c FULL JOIN u ON c.opponent_id = u.opponent_id"),
    "preferred_spelling": (preferred_spelling, SPELLING_SQL),
    "labels_conflicts": (label_conflicts, CONFLICT_SQL),
    "find_conflicts": (source_conflicts, 'SELECT content, \'source\' AS field, value, n, "values" FROM (SELECT content, value, n, count(*) OVER (PARTITION BY content) AS "values" FROM (SELECT sha256(text) AS content, source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL)) WHERE "values" > 1'),
    "validation_issues": (issues, ISSUES_SQL),
    "sequence_issues": (sequence_issues, SEQUENCE_SQL),
    "lookup_cascade": (lookup_cascade, CASCADE_SQL),
    "fuzzy_name_pairs": (near_names, NEAR_SQL),
    "fuzzy_brand_pairs": (near_brands, NEAR_BRANDS_SQL),
    "token_subset_pairs": (token_subsets, SUBSET_SQL),
    "prefix_extension_pairs": (prefix_extensions, PREFIX_SQL),
    "asof_name": (name_as_of, AS_OF_SQL),
    "nearest_within_days": (nearest_within_days, NEAREST_SQL),
    "interval_stabbing": (interval_stabbing, "SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS since, CAST(max(year(o_orderdate)) AS INTEGER) AS until FROM orders GROUP BY o_custkey HAVING min(year(o_orderdate)) <= 1995 AND max(year(o_orderdate)) >= 1995"),
    "year_span_expand": (year_span_expand, "SELECT o_custkey, CAST(unnest(range(CAST(min(year(o_orderdate)) AS BIGINT), CAST(max(year(o_orderdate)) + 1 AS BIGINT))) AS INTEGER) AS year FROM orders GROUP BY o_custkey"),
    "singular_holder_conflicts": (singular_holders, HOLDERS_SQL),
    "html_links": (html_links, "SELECT page_id, CAST(i - 1 AS INTEGER) AS nth, l[i] AS target FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages), unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS u(i)"),
    "html_strip": (html_strip, None),
    "url_parts": (url_parts, URL_SQL),
    "fulltext_and_search": (fulltext_and, "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'thing'])"),
    "inverted_index": (inverted_index, INDEX_SQL),
    "ranked_search": (ranked_search, RANKED_SQL),
    "phrase_dictionary_hits": (phrase_hits, PHRASE_SQL),
    "whole_phrase_hits": (whole_phrases, WHOLE_SQL),
    "passage_containment": (containment, None),
    "two_line_windows": (two_line_windows, TWO_SQL),
    "genre_class": (genre_class, GENRE_SQL),
    "score_like_pairs": (score_like_pairs, None),
    "evidence_scoring": (evidence_scores, f"WITH {FRAGMENTS_SQL} SELECT doc_id, score, confidence FROM f"),
    "cluster_rank_discount": (clusters, CLUSTER_SQL),
    "voted_dates": (voted_dates, VOTED_SQL),
    "decision_ladder": (decisions, DECISION_SQL),
    "assignment_small": (assignment, None),
    "snapshot_diff": (snapshot_diff, DIFF_SQL),
    "additive_audit": (additive_audit, AUDIT_SQL),
    "payload_hash_changes": (payload_hash_changes, HASH_SQL),
    "field_merge": (field_merge, FIELD_MERGE_SQL),
    "completeness_score": (completeness, COMPLETE_SQL),
    "rate_limit_verdicts": (rate_limit, None),
    "windowed_counts": (windowed_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "user_sessions": (user_sessions, SESSIONS_SQL),
    "latest_log": (latest_log, LATEST_SQL),
}
