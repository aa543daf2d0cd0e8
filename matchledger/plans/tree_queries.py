"""Queries on nested values: orders with their lines as trees, walked, searched, and compared between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import provenance, trees


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as trees, and a later state of them: some gone, lines gone or with another price, tags dropped, states changed or concluded, dates refreshed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_linenumber").alias("nr"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    k = F.col("o_orderkey")

    def records(later: bool) -> DataFrame:
        price = F.when(F.lit(later) & (F.col("l_suppkey") % 7 == 0), F.col("q") + 1).otherwise(F.col("q"))
        own = lines.filter(f"NOT {later} OR l_partkey % 11 <> 3").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("id", F.col("nr").alias("line"), price.alias("price")))).alias("lines"))
        status = F.when(F.lit(later) & (k % 9 == 0), "X").when(F.lit(later) & (k % 5 == 0), "played").when(k % 2 == 0, "scheduled").otherwise(F.col("o_orderstatus"))
        tags = F.when(F.lit(later) & (k % 4 == 0), F.array("o_orderpriority")).otherwise(F.array("o_orderpriority", F.concat(F.lit("m"), F.month("o_orderdate"))))
        source = F.struct(F.lit(2 if later else 1).alias("retrievedAt"), F.col("o_custkey").alias("customer"))
        rows = table(spark, sf_dir, "orders").filter(f"NOT {later} OR o_orderkey % 50 <> 1").join(own, k == F.col("l_orderkey"), "left")
        return rows.select("o_orderkey", F.to_json(F.struct(status.alias("status"), tags.alias("tags"), source.alias("source"), "lines")).alias("tree"))

    return records(False), records(True)


def structural_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the later state of the orders lost of the earlier one."""
    return trees.losses(*_snapshots(spark, sf_dir), "o_orderkey", "tree").select("o_orderkey", "path", "change")


LOSSES_SQL = """
WITH kept AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'scheduled' ELSE o_orderstatus END AS was,
                     CASE WHEN o_orderkey % 9 = 0 THEN 'X' WHEN o_orderkey % 5 = 0 THEN 'played' WHEN o_orderkey % 2 = 0 THEN 'scheduled' ELSE o_orderstatus END AS now FROM orders WHERE o_orderkey % 50 <> 1),
lines AS (SELECT k.o_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey % 11 = 3 AS gone, l_suppkey % 7 = 0 AS dearer, count(*) FILTER (l_partkey % 11 <> 3) OVER (PARTITION BY k.o_orderkey) AS rest
          FROM kept k JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, '' AS path, 'remove' AS change FROM orders WHERE o_orderkey % 50 = 1
UNION ALL SELECT o_orderkey, '/status', 'mutate' FROM kept WHERE was <> now AND NOT (was = 'scheduled' AND now = 'played')
UNION ALL SELECT o_orderkey, '/tags[1]', 'remove' FROM kept WHERE o_orderkey % 4 = 0 AND 'm' || month(o_orderdate) <> o_orderpriority
UNION ALL SELECT DISTINCT o_orderkey, '/lines', 'remove' FROM lines WHERE rest = 0
UNION ALL SELECT o_orderkey, '/lines/' || id, 'remove' FROM lines WHERE rest > 0 AND gone
UNION ALL SELECT o_orderkey, '/lines/id=' || id || '/price', 'mutate' FROM lines WHERE rest > 0 AND dearer AND NOT gone"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each path of the orders' trees holds which type, list places left out."""
    return trees.shapes(_snapshots(spark, sf_dir)[0], "tree")


NODES_SQL = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'scheduled' ELSE o_orderstatus END AS status FROM orders),
l AS (SELECT l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linenumber AS nr, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, o_orderkey FROM o JOIN lineitem ON l_orderkey = o_orderkey),
json AS (SELECT o_orderkey, string_agg('{"id":"' || id || '","line":' || nr || ',"price":' || q || '}', ',' ORDER BY id, nr, CAST(q AS INTEGER)) AS lines, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT '{"lines":[' || lines || '],"source":{"customer":' || o_custkey || ',"retrievedAt":1},"status":"' || status || '","tags":["' || o_orderpriority || '","m' || month(o_orderdate) || '"]}' AS tree, lines, json.n, o.* FROM o JOIN json USING (o_orderkey)),
bare AS (SELECT o.*, '{"source":{"customer":' || o_custkey || ',"retrievedAt":1},"status":"' || status || '","tags":["' || o_orderpriority || '","m' || month(o_orderdate) || '"]}' AS tree FROM o ANTI JOIN json USING (o_orderkey)),
rows AS (
  SELECT '' AS path, 'object' AS type, 4 AS size, tree AS value FROM t UNION ALL SELECT '', 'object', 3, tree FROM bare
  UNION ALL SELECT '/status', 'text', NULL, status FROM o UNION ALL SELECT '/tags', 'array', 2, '["' || o_orderpriority || '","m' || month(o_orderdate) || '"]' FROM o
  UNION ALL SELECT '/tags/*', 'text', NULL, unnest([o_orderpriority, 'm' || month(o_orderdate)]) FROM o
  UNION ALL SELECT '/source', 'object', 2, '{"customer":' || o_custkey || ',"retrievedAt":1}' FROM o UNION ALL SELECT '/source/retrievedAt', 'integer', NULL, '1' FROM o UNION ALL SELECT '/source/customer', 'integer', NULL, CAST(o_custkey AS VARCHAR) FROM o
  UNION ALL SELECT '/lines', 'array', n, '[' || lines || ']' FROM t UNION ALL SELECT '/lines/*', 'object', 3, '{"id":"' || id || '","line":' || nr || ',"price":' || q || '}' FROM l
  UNION ALL SELECT '/lines/*/id', 'text', NULL, id FROM l UNION ALL SELECT '/lines/*/line', 'integer', NULL, CAST(nr AS VARCHAR) FROM l UNION ALL SELECT '/lines/*/price', 'integer', NULL, q FROM l)
SELECT path, type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, max(value) AS largest FROM rows GROUP BY ALL"""


def objects_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects at any depth that have a status and two tags, or a line and a price."""
    found = trees.objects(_snapshots(spark, sf_dir)[0], "o_orderkey", "tree", {"status": "text", "tags": "array(2)"}, {"line": "integer", "price": "integer"})
    return found.select("o_orderkey", F.when(F.col("search") == 0, F.col("path")).otherwise("/lines").alias("path"), F.concat_ws("|", "values").alias("found"))


OBJECTS_SQL = """
SELECT o_orderkey, '' AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'scheduled' ELSE o_orderstatus END || '|["' || o_orderpriority || '","m' || month(o_orderdate) || '"]' AS found FROM orders
UNION ALL SELECT o_orderkey, '/lines', l_linenumber || '|' || CAST(l_quantity AS INTEGER) FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def copied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed values kept over newly fetched ones, and the notes that are not null."""
    k = F.col("o_orderkey")
    score = lambda n: F.struct((k % n).alias("score"), (k % 3).alias("sets"))
    rows = table(spark, sf_dir, "orders").select(
        k, F.struct(F.when(k % 4 != 0, score(5)).alias("home"), F.col("o_orderstatus").alias("state")).alias("reviewed"), F.struct(F.when(k % 6 != 0, score(7)).alias("home"), F.lit("new").alias("state")).alias("fetched"),
        trees.compact(F.create_map(F.lit("a"), F.when(k % 2 == 0, F.lit(1)), F.lit("b"), F.lit(2))).alias("notes"),
    )
    merged = trees.copied(rows, "reviewed", "fetched", ["home.score", "state"])
    return merged.select("o_orderkey", F.col("fetched.home.score").alias("score"), F.col("fetched.home.sets").alias("sets"), F.col("fetched.state").alias("state"), F.array_join(F.map_keys("notes"), ",").alias("notes"))


COPIED_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 7 END AS score,
       CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 3 END AS sets, o_orderstatus AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS notes FROM orders"""


def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the members of JSON values as they are written, where a number in quotes is a text."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", r": *([0-9]+)", ': "$1"')).when(F.col("event_id") % 7 == 1, F.lit("{}")).when(F.col("event_id") % 7 == 2, F.lit('{"k": true}')).when(F.col("event_id") % 7 != 3, F.col("props")).alias("props"))
    own = trees.nodes(rows, "event_id", "props").filter("path = '/k'").select("event_id", "type", "value")
    kinds = rows.join(own, "event_id", "left").withColumn("kind", F.when(F.col("props").isNull(), "none").otherwise(F.coalesce("type", F.lit("absent"))))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.when(F.col("type") == "integer", F.col("value").try_cast("long"))).alias("largest"))


JSON_TYPES_SQL = r"""
WITH e AS (SELECT CASE event_id % 7 WHEN 0 THEN regexp_replace(props, ': *([0-9]+)', ': "\1"', 'g') WHEN 1 THEN '{}' WHEN 2 THEN '{"k": true}' WHEN 3 THEN NULL ELSE props END AS props FROM events),
k AS (SELECT CASE WHEN props IS NULL THEN 'none' ELSE coalesce(CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'real' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' END, 'absent') END AS kind,
             TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM e)
SELECT kind, count(*) AS n, max(v) FILTER (kind = 'integer') AS largest FROM k GROUP BY kind"""

def removed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some are gone from the later state: every other one of them handed its lines on to the next order, some were given leave."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("k"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("line"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    moved = lines.withColumn("k", F.when(F.col("k") % 100 == 1, F.col("k") + 1).otherwise(F.col("k")))
    sets = lambda rows: rows.groupBy("k").agg(F.collect_set("line").alias("parts"))
    base = orders.filter("k % 70 <> 3").join(sets(lines), "k", "left")
    head = orders.filter("k % 50 <> 1").join(sets(moved), "k", "left")
    return provenance.removals(base, head, "k", "parts", orders.filter("k % 250 = 51"))


REMOVED_SQL = """
WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line FROM lineitem),
base AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 70 <> 3), head AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 1),
hl AS (SELECT DISTINCT CASE WHEN k % 100 = 1 THEN k + 1 ELSE k END AS k, line FROM l), h AS (SELECT hl.* FROM hl JOIN head USING (k)),
gone AS (SELECT k FROM base ANTI JOIN head USING (k)), n AS (SELECT k, count(*) AS n FROM l JOIN gone USING (k) GROUP BY k),
met AS (SELECT l.k, h.k AS t, count(*) AS c FROM l JOIN gone USING (k) JOIN h ON h.line = l.line GROUP BY ALL),
best AS (SELECT met.k, min(t) AS merged_into FROM met JOIN n ON met.k = n.k AND c = n GROUP BY met.k)
SELECT k, CASE WHEN merged_into IS NOT NULL THEN 'merged' WHEN k % 250 = 51 THEN 'approved' ELSE 'destroyed' END AS status, merged_into FROM gone LEFT JOIN best USING (k)
UNION ALL SELECT k, 'new', NULL FROM head ANTI JOIN base USING (k)"""

DEFINED = {
    "structural_losses": (structural_losses, LOSSES_SQL),
    "tree_nodes": (tree_nodes, NODES_SQL),
    "objects_anywhere": (objects_anywhere, OBJECTS_SQL),
    "copied_paths": (copied_paths, COPIED_SQL),
    "json_types": (json_types, JSON_TYPES_SQL),
    "removed_records": (removed_records, REMOVED_SQL),
}
