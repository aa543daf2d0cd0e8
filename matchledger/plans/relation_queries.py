"""Queries on relations between records, orders, and reports over groups and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import COUNTED, ENCOUNTERS_SQL, encounters, table
from ..operators import relations, reports
from .record_queries import CLAIMS_SQL, _claims, _matches

DAYS = 30
PRIORITIES = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("season", F.year("o_orderdate"))


def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("priority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return relations.compatible_pairs(rows, "o_orderkey", ["o_custkey", "season"], "day", DAYS, ["priority"])


DUPLICATES_SQL = f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS p FROM orders)
SELECT a.k AS a, b.k AS b FROM o a JOIN o b ON a.c = b.c AND a.y = b.y AND a.k < b.k AND abs(date_diff('day', a.d, b.d)) <= {DAYS} AND coalesce(a.p = b.p, TRUE)"""


def possible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _matches(spark, sf_dir).filter(F.col("status").isin(*COUNTED))
    return relations.possible_links(_claims(spark, sf_dir), matches, ["season", "opponent_id", "goal_difference"], "claim_id", "match_id")


def running_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.running_ids(_orders(spark, sf_dir), "season", ["day", "o_orderkey"]).select("o_orderkey", "nth", "running_id")


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.population(_orders(spark, sf_dir), "o_custkey")


def quiet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.quiet_buckets(_orders(spark, sf_dir), "day", 0.6)


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer")
    head = base.filter("c_custkey % 10 <> 3").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    head = head.unionByName(base.filter("c_custkey % 5 = 1").withColumn("c_custkey", -F.col("c_custkey") - 1))
    return relations.metric_report(base, head, "c_custkey", ["c_name", "c_mktsegment"])


METRIC_SQL = """
WITH h AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 10 <> 3
  UNION ALL SELECT -c_custkey - 1, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 = 1),
j AS (SELECT b.c_custkey AS bk, h.k AS hk, b.c_name IS DISTINCT FROM h.c_name AS dn, b.c_mktsegment IS DISTINCT FROM h.s AS ds FROM customer b FULL JOIN h ON b.c_custkey = h.k)
SELECT count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (hk IS NULL) AS removed, count(*) FILTER (bk IS NOT NULL AND hk IS NOT NULL AND (dn OR ds)) AS changed,
  count(*) FILTER (bk IS NOT NULL AND hk IS NOT NULL AND dn) AS changed_c_name, count(*) FILTER (bk IS NOT NULL AND hk IS NOT NULL AND ds) AS changed_c_mktsegment FROM j"""


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and the first date of each class."""
    rows = _orders(spark, sf_dir).groupBy("o_orderpriority")
    return rows.agg(*(F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("day"))).alias("first_open"))


STANDINGS_SQL = f"""
WITH {ENCOUNTERS_SQL}, c AS (SELECT * FROM encounters WHERE status IN ('played', 'awarded')),
s AS (SELECT season, competition, home_id AS team, home_score AS gf, away_score AS ga FROM c UNION ALL SELECT season, competition, away_id, away_score, home_score FROM c),
t AS (SELECT season, competition, team, count(*) AS played, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM s GROUP BY ALL)
SELECT *, 3 * wins + draws AS points, CAST(row_number() OVER (PARTITION BY season, competition ORDER BY 3 * wins + draws DESC, goals_for - goals_against DESC, goals_for DESC, team) AS INTEGER) AS position FROM t"""


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.standings(encounters(spark, sf_dir).filter(F.col("status").isin(*COUNTED)), ["season", "competition"])


def suspicious_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as results of leagues and cups, confirmed or not by up to two providers: those with a wide margin that ask for a second look."""
    n, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    providers = F.array_compact(F.array(F.when(n % 3 > 0, "a"), F.when(n % 3 > 1, F.when(n % 2 == 0, "a").otherwise("b"))))
    rows = table(spark, sf_dir, "lineitem").select(
        name.alias("match"), (q % 12).alias("home"), F.when(n % 13 != 0, (q * 7 + F.col("l_linenumber")) % 12).alias("away"), F.when(F.col("l_suppkey") % 4 != 0, "league").otherwise("cup").alias("competition_type"),
        F.when(n % 5 < 3, "confirmed").otherwise("probable").alias("confidence"), providers.alias("providers"),
    )
    return reports.doubtful_results(rows)


SUSPICIOUS_SQL = """
WITH m AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS match, abs(CAST(l_quantity AS INTEGER) % 12 - (CAST(l_quantity AS INTEGER) * 7 + l_linenumber) % 12) AS margin,
                  l_suppkey % 4 <> 0 AS league, l_partkey % 5 < 3 AND NOT (l_partkey % 3 = 2 AND l_partkey % 2 = 1) AS alone FROM lineitem WHERE l_partkey % 13 <> 0)
SELECT match, CAST(margin AS INTEGER) AS margin, CASE WHEN league THEN 'league_margin' ELSE 'confirmed_by_one' END AS reason FROM m WHERE margin >= 8 AND (league OR alone)"""


def season_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without a counted match between an opponent's first and last one."""
    counted = _matches(spark, sf_dir).filter(F.col("status").isin(*COUNTED)).select("opponent_id", F.trunc("match_date", "month").alias("month")).distinct()
    span = counted.groupBy("opponent_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select("opponent_id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return every.join(counted, ["opponent_id", "month"], "left_anti").groupBy("opponent_id").agg(F.count("*").alias("gaps"), F.min("month").alias("first_gap"))


GAPS_SQL = f"""
WITH {CLAIMS_SQL}, c AS (SELECT DISTINCT opponent_id, CAST(date_trunc('month', match_date) AS DATE) AS month FROM matches WHERE status IN ('played', 'awarded')),
s AS (SELECT opponent_id, unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS month FROM c GROUP BY opponent_id)
SELECT opponent_id, count(*) AS gaps, CAST(min(s.month) AS DATE) AS first_gap FROM s ANTI JOIN c ON s.opponent_id = c.opponent_id AND CAST(s.month AS DATE) = c.month GROUP BY opponent_id"""


def gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one source has that another lacks, by class: taking part numbers as keys."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    listed = table(spark, sf_dir, "part").filter("p_size % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    both = sold.withColumn("s", F.lit(1)).join(listed.withColumn("p", F.lit(1)), "l_partkey", "full")
    name = F.when(F.col("s").isNull(), "only_listed").when(F.col("p").isNull(), "only_sold").otherwise("matched")
    return both.groupBy(name.alias("class")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("least"))


def unresolved_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as written that no nation resolves, most frequent first, with the customers that bear them."""
    said = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 3 == 0, 20).otherwise(0)).cast("string")).alias("said"))
    missing = said.join(table(spark, sf_dir, "nation"), said["said"] == F.col("n_name"), "left_anti")
    return missing.groupBy("said").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_use"))


def missing_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that lack a language, a text, a label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")).distinct(), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("no_text"), F.count_if(F.col("has").isNull()).alias("no_label"))


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language with totals of each source and of all."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"), "n_chars")
    return docs.rollup("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "documents", "chars")


def json_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each nation as a JSON array, and an object of two counts."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"), F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("neg"))
    return rows.select("c_nationkey", F.to_json("s").alias("segments"), F.to_json(F.struct(F.col("n").alias("all"), F.col("neg").alias("negative"))).alias("counts"))


def regional_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables joined; the total of each region's nation totals, beside the largest of them."""
    per = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    joined = per.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sum("n").alias("suppliers"), F.max("n").alias("most"), F.max_by("n_name", F.struct("n", "n_name")).alias("leader"))


def joined_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined on a computed key: open ones to the customer's nation, others to a nation by month."""
    o = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.when(F.col("o_orderstatus") == "O", F.col("c_nationkey")).otherwise(F.month("o_orderdate"))
    return o.withColumn("key", key).join(table(spark, sf_dir, "nation"), F.col("key") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


def either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each nation takes part, at home or away."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return relations.either_key(encounters(spark, sf_dir), "home_id", "away_id", names, "n_nationkey", ["match_id", "n_name"]).groupBy("n_name").agg(F.count("*").alias("n"))


def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above the mean of their customer, and that customer's latest order: both as joins on aggregates."""
    o = _orders(spark, sf_dir)
    own = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return o.join(own, "o_custkey").filter(F.col("o_totalprice") > F.col("mean")).select("o_orderkey", "latest")


def primary_competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The competition that stands for each season: by a stated order, then the one with most matches."""
    rows = _orders(spark, sf_dir).groupBy("season", "o_orderpriority").agg(F.count("*").alias("played"))
    return relations.primary(rows, "season", relations.cases_first("o_orderpriority", PRIORITIES), [F.desc("played"), F.col("o_orderpriority")])


def sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under several orders: a default date for missing ones, missing last, numbers before text, case ignored."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type")).alias("label"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("written"))
    number, rest = F.regexp_extract("label", r"^\d+", 0).cast("int"), F.regexp_replace("label", r"^\d+\s*", "")
    orders = {"by_default": [F.coalesce("size", F.lit(25)), F.col("p_partkey")], "nulls_last": [F.col("size").asc_nulls_last(), F.col("p_partkey")], "by_number": [number, rest, F.col("p_partkey")], "any_case": [F.lower("written"), F.col("p_partkey")]}
    return rows.select("p_partkey", *(F.row_number().over(Window.partitionBy(F.col("p_partkey") % 64).orderBy(*o)).alias(k) for k, o in orders.items()))


SORTED_SQL = r"""
WITH r AS (SELECT p_partkey, p_partkey % 64 AS g, concat(CAST(p_size AS VARCHAR), ' ', p_type) AS label, CASE WHEN p_size % 5 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS written FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY g ORDER BY coalesce(size, 25), p_partkey) AS INTEGER) AS by_default, CAST(row_number() OVER (PARTITION BY g ORDER BY size ASC NULLS LAST, p_partkey) AS INTEGER) AS nulls_last,
  CAST(row_number() OVER (PARTITION BY g ORDER BY CAST(regexp_extract(label, '^\d+') AS INTEGER), regexp_replace(label, '^\d+\s*', ''), p_partkey) AS INTEGER) AS by_number, CAST(row_number() OVER (PARTITION BY g ORDER BY lower(written), p_partkey) AS INTEGER) AS any_case FROM r"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each match as whole numbers."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    counted = F.col("status").isin(*COUNTED)
    return _matches(spark, sf_dir).select("match_id", one(counted & (F.col("result") == "S")).alias("won"), one(counted & (F.col("opponent_score") == 0)).alias("clean_sheet"), one(counted & (F.col("own_score") == 0)).alias("failed_to_score"), one(F.col("status") == "awarded").alias("awarded"))


def like_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a term literally, its wildcards escaped."""
    return table(spark, sf_dir, "nation").filter(F.expr(r"n_name LIKE '%N!_1%' ESCAPE '!'")).select("n_nationkey", "n_name")


def around_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.months_around(_orders(spark, sf_dir), "day").groupBy("month").agg(F.count("*").alias("n"))


def strongest_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest order of each customer: by status and price, the first found where they are equal."""
    rank = relations.cases_first("o_orderstatus", ["F", "P", "O"])
    return relations.primary(_orders(spark, sf_dir), "o_custkey", rank, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses built from rows, and words that a line's end divides put together again."""
    p = table(spark, sf_dir, "part")
    split = F.concat(F.substring("p_name", 1, 3), F.lit("-\n"), F.expr("substring(p_name, 4)"), F.lit(" x-\n9"))
    return p.select("p_partkey", F.concat_ws("/", F.lit("/parts"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_partkey").cast("string")).alias("url"), F.regexp_replace(split, r"(\p{L})-\n(\p{Ll})", "$1$2").alias("joined"))


def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first line paired with the line whose quantity is nearest, within ten."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("y"))
    least = rows.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "y")).alias("f")).select("l_orderkey", "f")
    met = rows.join(least, "l_orderkey").filter((F.struct("l_linenumber", "l_partkey", "y") != F.col("f")) & (F.abs(F.col("y") - F.col("f.y")) <= 10))
    return met.groupBy("l_orderkey").agg(F.min(F.struct(F.abs(F.col("y") - F.col("f.y")).alias("d"), "l_linenumber", "l_partkey")).alias("m")).select("l_orderkey", F.col("m.l_linenumber").alias("line"), F.col("m.d").alias("distance"))


NEAREST_LINES_SQL = """
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity AS y FROM lineitem),
f AS (SELECT k, min({'n': n, 'p': p, 'y': y}) AS f FROM r GROUP BY k),
m AS (SELECT r.k, min({'d': abs(y - f.y), 'n': n, 'p': p}) AS m FROM r JOIN f ON r.k = f.k WHERE {'n': n, 'p': p, 'y': y} <> f AND abs(y - f.y) <= 10 GROUP BY r.k)
SELECT k AS l_orderkey, m.n AS line, m.d AS distance FROM m"""

DEFINED = {
    "possible_duplicates": (possible_duplicates, DUPLICATES_SQL),
    "possible_links": (possible_links, f"WITH {CLAIMS_SQL}, k AS (SELECT season, opponent_id, goal_difference, count(*) AS links, min(match_id) AS first_link FROM matches WHERE status IN ('played', 'awarded') GROUP BY ALL) SELECT claim_id, coalesce(links, 0) AS links, first_link FROM claims LEFT JOIN k USING (season, opponent_id, goal_difference)"),
    "running_order": (running_order, "SELECT o_orderkey, CAST(n AS INTEGER) AS nth, concat(CAST(y AS VARCHAR), '-', lpad(CAST(n AS VARCHAR), 6, '0')) AS running_id FROM (SELECT o_orderkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders)"),
    "population_summary": (population, "WITH s AS (SELECT size, count(*) AS groups FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY ALL) GROUP BY size) SELECT size, groups, size = 1 AS singleton, round(100.0 * size * groups / (SELECT sum(size * groups) FROM s), 4) AS percent FROM s"),
    "quiet_buckets": (quiet_days, "WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM c) SELECT day, n, median FROM c, m WHERE n <= greatest(1.0, 0.6 * median)"),
    "metric_report": (metric_report, METRIC_SQL),
    "status_summary": (status_summary, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, min(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'O') AS first_open FROM orders GROUP BY o_orderpriority"),
    "standings": (standings, STANDINGS_SQL),
    "suspicious_results": (suspicious_results, SUSPICIOUS_SQL),
    "season_gaps": (season_gaps, GAPS_SQL),
    "gap_classes": (gap_classes, "WITH s AS (SELECT DISTINCT l_partkey AS k FROM lineitem), p AS (SELECT p_partkey AS k FROM part WHERE p_size % 4 <> 0) SELECT CASE WHEN s.k IS NULL THEN 'only_listed' WHEN p.k IS NULL THEN 'only_sold' ELSE 'matched' END AS class, count(*) AS n, min(coalesce(s.k, p.k)) AS least FROM s FULL JOIN p ON s.k = p.k GROUP BY 1"),
    "unresolved_opponents": (unresolved_opponents, "WITH s AS (SELECT c_custkey, 'NATION_' || CAST(c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END AS VARCHAR) AS said FROM customer) SELECT said, count(*) AS n, min(c_custkey) AS first_use FROM s WHERE said NOT IN (SELECT n_name FROM nation) GROUP BY said"),
    "missing_overview": (missing_overview, "SELECT source, count(*) AS documents, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (coalesce(length(text), 0) = 0) AS no_text, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS no_label FROM documents GROUP BY source"),
    "source_inventory": (source_inventory, "SELECT coalesce(s, 'all') AS source, coalesce(l, 'all') AS lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT coalesce(source, '?') AS s, coalesce(lang, '?') AS l, n_chars FROM documents) GROUP BY ROLLUP (s, l)"),
    "json_groups": (json_groups, "SELECT c_nationkey, CAST(to_json(list_sort(list(DISTINCT c_mktsegment))) AS VARCHAR) AS segments, CAST(to_json({'all': count(*), 'negative': count(*) FILTER (c_acctbal < 0)}) AS VARCHAR) AS counts FROM customer GROUP BY c_nationkey"),
    "regional_totals": (regional_totals, "WITH p AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) SELECT r_name, CAST(sum(n) AS BIGINT) AS suppliers, max(n) AS most, arg_max(n_name, {'n': n, 'm': n_name}) AS leader FROM p JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "joined_by_case": (joined_by_case, "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = CASE WHEN o_orderstatus = 'O' THEN c_nationkey ELSE month(o_orderdate) END GROUP BY n_name"),
    "either_side": (either_side, f"WITH {ENCOUNTERS_SQL} SELECT n_name, count(*) AS n FROM encounters JOIN nation ON home_id = n_nationkey OR away_id = n_nationkey GROUP BY n_name"),
    "above_average": (above_average, "SELECT o_orderkey, (SELECT arg_max(b.o_orderkey, {'d': b.o_orderdate, 'k': b.o_orderkey}) FROM orders b WHERE b.o_custkey = o.o_custkey) AS latest FROM orders o WHERE o_totalprice > (SELECT avg(a.o_totalprice) FROM orders a WHERE a.o_custkey = o.o_custkey)"),
    "primary_competitions": (primary_competitions, "SELECT season, o_orderpriority, played FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority, count(*) AS played FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY season ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, played DESC, o_orderpriority) = 1"),
    "sorted_places": (sorted_places, SORTED_SQL),
    "match_flags": (flags, f"WITH {CLAIMS_SQL} SELECT match_id, CAST(status IN ('played', 'awarded') AND result = 'S' AS INTEGER) AS won, CAST(status IN ('played', 'awarded') AND opponent_score = 0 AS INTEGER) AS clean_sheet, CAST(status IN ('played', 'awarded') AND own_score = 0 AS INTEGER) AS failed_to_score, CAST(status = 'awarded' AS INTEGER) AS awarded FROM matches"),
    "escaped_like": (like_escaped, "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '%N!_1%' ESCAPE '!'"),
    "month_windows": (around_months, "SELECT strftime(d + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month, count(*) AS n FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders), (VALUES (-1), (0), (1)) AS v(k) GROUP BY 1"),
    "strongest_per_key": (strongest_role, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) = 1"),
    "built_urls": (next_pages, "SELECT p_partkey, '/parts/' || lower(replace(p_brand, '#', '-')) || '/' || CAST(p_partkey AS VARCHAR) AS url, CASE WHEN regexp_matches(p_name[3:3], '\\p{L}') AND regexp_matches(p_name[4:4], '\\p{Ll}') THEN p_name ELSE p_name[1:3] || '-' || chr(10) || p_name[4:] END || ' x-' || chr(10) || '9' AS joined FROM part"),
    "nearest_lines": (nearest_lines, NEAREST_LINES_SQL),
}
