"""Queries on landed pages and responses, series, rights and what is left to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import table
from ..sources import landed, policy, records


def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.discovered(table(spark, sf_dir, "pages"), "page_id", "html")


DISCOVERED_SQL = """
SELECT target, count(*) AS pages, min(page_id) AS first_page
FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target"""


def cached_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses of their address without query and fragment, retrieved in the order of their ids."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[^?#]*", 0).alias("url"), F.col("page_id").alias("retrieved"), F.length("html").cast("long").alias("n_chars"))
    return landed.latest(pages, "url", "retrieved")


CACHED_SQL = """
SELECT url, sha256(url) AS cache_key, max(page_id) AS retrieved, arg_max(n_chars, page_id) AS n_chars
FROM (SELECT regexp_extract(url, '^[^?#]*') AS url, page_id, length(html) AS n_chars FROM pages) GROUP BY url"""


def strict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of event properties as records that must hold k; every seventh has another key, every eleventh is cut off."""
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 7 == 0, F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    files = e.select(F.col("event_id").cast("string").alias("path"), body.alias("content"))
    return records.parsed(files, T.StructType([T.StructField("k", T.LongType())]), ("k",))[1]


STRICT_SQL = """
SELECT CAST(event_id AS VARCHAR) AS path, unnest(CASE WHEN event_id % 7 = 0 THEN ['q', 'k'] ELSE [''] END) AS field,
       unnest(CASE WHEN event_id % 7 = 0 THEN ['unknown key', 'required'] ELSE ['unreadable'] END) AS message
FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0"""


def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches over whole documents, merged by source."""
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    hits = [d.filter(F.lower("text").contains(q)).select("source", F.lit(q).alias("query"), F.array(F.col("lang")).alias("fragments")) for q in ("the", "que", "und")]
    return landed.merged_hits(hits[0].unionByName(hits[1]).unionByName(hits[2]), "source", "query", "fragments").select("source", F.array_join("queries", ",").alias("queries"), F.array_join("fragments", ",").alias("fragments"))


MERGED_SQL = """
SELECT source, string_agg(DISTINCT q, ',' ORDER BY q) AS queries, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS fragments
FROM documents, (VALUES ('the'), ('que'), ('und')) AS v(q) WHERE source IS NOT NULL AND contains(lower(text), q) GROUP BY source"""


def series_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years between a customer's first and last order with no order, or with several."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return landed.series_gaps(o, "o_custkey", "year")


GAPS_SQL = """
WITH held AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL),
every AS (SELECT o_custkey, CAST(unnest(range(CAST(min(year) AS BIGINT), CAST(max(year) + 1 AS BIGINT))) AS INTEGER) AS year FROM held GROUP BY o_custkey)
SELECT o_custkey, year, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem
FROM every LEFT JOIN held USING (o_custkey, year) WHERE n IS DISTINCT FROM 1"""


def rights_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers, with rights by their keys; and the rows of lineitem that each may not publish."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pick = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), (key % by + 1).cast("int"))
    providers = s.select(
        key.alias("provider_id"), pick(3, "allowed", "denied", "unknown").alias("public_redistribution"),
        pick(4, "pending", "granted", "requested", "denied").alias("permission_status"), pick(5, "pending", "accepted_risk", "blocked", "pending", "pending").alias("ingest_decision"),
    )
    return policy.refused(table(spark, sf_dir, "lineitem"), providers, "l_suppkey", policy.may_publish())


RIGHTS_SQL = """
SELECT l_suppkey, count(*) AS "rows" FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE NOT coalesce(CASE WHEN s_suppkey % 5 = 2 THEN false WHEN s_suppkey % 3 = 0 THEN true WHEN s_suppkey % 3 = 1 THEN false
                        ELSE s_suppkey % 4 = 1 OR s_suppkey % 5 = 1 END, false) GROUP BY l_suppkey"""

DEFINED = {
    "discovered_links": (discovered_links, DISCOVERED_SQL),
    "cached_responses": (cached_responses, CACHED_SQL),
    "strict_records": (strict_records, STRICT_SQL),
    "merged_hits": (merged_hits, MERGED_SQL),
    "series_gaps": (series_gaps, GAPS_SQL),
    "rights_gate": (rights_gate, RIGHTS_SQL),
}
