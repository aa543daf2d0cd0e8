"""URL filters (operator 13): curated rules, and association rules mined by FP-growth for the URLs that no curated rule fits.

A URL is cut into host and path (``with_parts``) and into at most ``len(ROLES)`` tokens, one for each role: scheme, last label of the host,
last two labels, first label of three or more, first directory, how the path ends, the set of query keys, a fragment
(``with_tokens``). Labelled URLs and their labels are the baskets of Spark's FP-growth; of the rules it finds, those
that conclude a label with enough support and confidence stay, and of those the ones that no more general rule of the same label
equals (``mined``). As a basket has one token a role, it has at most 2**len(ROLES) subsets, so frequent
sets stay bounded by 2**len(ROLES) / min_support however large or hot the input is.

Matching keeps rules in an inverted index: each stands under its rarest token. Distinct token sets meet the index on their tokens,
a rule holds where the set contains all of its tokens, and the best rule decides: highest confidence, then
support, then the smallest antecedent in byte order. URLs that no rule matches get the more frequent label of those learnt
from (``allow`` if tied or without any).

Null urls, and urls without ``://``, have an empty host, an empty path and no tokens. Very long tokens count by their MD5. Repeated rows and
ties are judged alike; an empty table gives no rows; without labels only the curated rules and ``allow`` are left. Other columns
pass through; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: The roles of tokens, in the order in which a URL's tokens stand.
ROLES = ("scheme", "top", "site", "sub", "dir", "end", "query", "fragment")
LONG_TOKEN = 64
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: The curated list of the query: (host and path, verdict).
CURATED = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

RULES = "antecedent array<string>, label string, n long, confidence double"


def _low(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    rest = _rest(F.col(url))
    return df.withColumns({"host": _low(F.regexp_extract(rest, "^[^/?#]*", 0)), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def with_tokens(df: DataFrame, name: str = "tokens", url: str = "url") -> DataFrame:
    """Add the tokens of a URL, as role=value."""
    u = F.col(url)
    rest = _rest(u)
    host, path = _low(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    labels, query = F.split(host, r"\."), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))))
    last = F.substring_index(path, "/", -1)
    values = {
        "scheme": _low(F.substring_index(u, "://", 1)),
        "top": F.when(host != "", F.element_at(labels, -1)),
        "site": F.when(F.size(labels) >= 2, F.substring_index(host, ".", -2)),
        "sub": F.when(F.size(labels) >= 3, F.get(labels, F.lit(0))),
        "dir": F.when(F.length(path) > 1, F.regexp_extract(path, "^/*([^/]*)", 1)),
        "end": F.when(F.length(path) > 1, F.when(last == "", "/").when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1))),
        "query": F.when(query != "", F.array_join(keys, "&")),
        "fragment": F.when(F.contains(rest, F.lit("#")), "#"),
    }
    short = lambda v: F.when(F.length(v) > LONG_TOKEN, F.md5(v)).otherwise(v)
    each = F.array_compact(F.array(*[F.concat(F.lit(role + "="), short(values[role])) for role in ROLES]))
    return df.withColumn(name, F.when(F.contains(u, F.lit("://")), each).otherwise(F.array().cast("array<string>")))


def with_curated(df: DataFrame, rules: Sequence[tuple[str, str]] = CURATED) -> DataFrame:
    """Add rule and verdict by the longest rule that fits, null where none does; needs host and path. A rule fits its host and
    all subdomains, if the path starts with the rule's; of equally long ones block wins, then byte order. The list is the caller's and
    goes into the plan; a URL looks up only the rules of its own last labels."""
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    hosts: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        hosts.setdefault(host, []).append((slash + path, verdict, rule))
    entry = lambda r: F.struct(F.lit(len(r[2])).alias("size"), F.lit(r[1]).alias("verdict"), F.lit(r[2]).alias("rule"), F.lit(r[0]).alias("path"))
    known = F.create_map(*[x for host, found in sorted(hosts.items()) for x in (F.lit(host), F.array(*map(entry, found)))])
    looked = [F.try_element_at(known, F.substring_index("host", ".", -k)) for k in range(1, max(h.count(".") for h in hosts) + 2)]
    near = F.flatten(F.array_compact(F.array(*looked)))
    best = F.array_max(F.filter(near, lambda r: F.startswith(F.col("path"), r["path"])))
    return df.withColumn("_uf_best", best).withColumns({"rule": F.col("_uf_best.rule"), "verdict": F.col("_uf_best.verdict")}).drop("_uf_best")


def _index(rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """Every rule under the rarest of its tokens (rarity: token, freq)."""
    each = rules.withColumn("token", F.explode("antecedent")).join(rarity, "token")
    return each.groupBy("antecedent", "label", "n", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))


def _hits(sets: DataFrame, index: DataFrame) -> DataFrame:
    """(tokens and the rule) for every rule whose antecedent a token set contains."""
    met = sets.withColumn("token", F.explode("tokens")).join(index, "token").drop("token")
    return met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules, rarity of their tokens) from (tokens, label); a row without label is ignored. n is how often tokens and label
    stand together."""
    spark = labelled.sparkSession
    baskets = labelled.filter("label IS NOT NULL").select(F.concat("tokens", F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    if baskets.isEmpty():
        return spark.createDataFrame([], RULES), spark.createDataFrame([], "token string, freq long")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    frequent = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    labels = F.filter("items", lambda x: F.startswith(x, F.lit("label=")))
    frequent = staged(frequent, "frequent_tokens").withColumn("label", F.get(labels, F.lit(0)))
    sets = frequent.filter("label IS NULL").select(F.col("items").alias("antecedent"), F.col("freq").alias("with"))
    both = frequent.filter("label IS NOT NULL AND size(items) > 1").select(F.array_remove("items", F.col("label")).alias("antecedent"), F.substr("label", F.lit(7)).alias("label"), F.col("freq").alias("n"))
    rules = both.join(sets, "antecedent").withColumn("confidence", F.col("n") / F.col("with")).filter(F.col("confidence") >= min_confidence)
    rules = staged(rules.select("antecedent", "label", "n", "confidence"), "url_rules")
    rarity = frequent.filter("label IS NULL AND size(items) = 1").select(F.get("items", F.lit(0)).alias("token"), "freq")
    return _general(rules, rarity), rarity


def _general(rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """Drop every rule that one with fewer of its tokens, and its label, equals or beats in confidence."""
    asked = rules.select(F.col("antecedent").alias("tokens"), F.col("label").alias("own"), F.col("confidence").alias("sure"))
    beaten = _hits(asked, _index(rules, rarity)).filter("label = own AND confidence >= sure AND size(antecedent) < size(tokens)")
    return rules.join(beaten.select(F.col("tokens").alias("antecedent"), "label").distinct(), ["antecedent", "label"], "left_anti")


def best_labels(sets: DataFrame, rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """(tokens, label) of every distinct token set that a rule matches."""
    order = F.struct(-F.col("confidence"), -F.col("n"), F.array_join("antecedent", "\x1f"), "label")
    return _hits(sets.select("tokens").distinct(), _index(rules, rarity)).groupBy("tokens").agg(F.min_by("label", order).alias("label"))


def filtered(df: DataFrame, labelled: DataFrame, curated: Sequence[tuple[str, str]] = CURATED, url: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of ``df`` with host, path, rule and verdict; ``labelled`` (url, label) is what the method learns from.
    URLs are grouped by their tokens before they meet the rules."""
    taught = with_tokens(labelled.select("url", "label")).select("tokens", "label")
    rules, rarity = mined(taught, min_support, min_confidence)
    n, blocked = taught.filter("label IS NOT NULL").agg(F.count("*"), F.count_if(F.col("label") == "block")).first()
    rest = df.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else df
    own = with_tokens(with_curated(with_parts(rest, url), curated), "_uf_tokens", url)
    found = best_labels(own.filter("verdict IS NULL").select(F.col("_uf_tokens").alias("tokens")), rules, rarity)
    found = staged(found.select(F.col("tokens").alias("_uf_tokens"), F.col("label").alias("_uf_label")), "url_labels")
    verdict = F.coalesce("verdict", "_uf_label", F.lit("block" if 2 * blocked > n else "allow"))
    return own.join(found, "_uf_tokens", "left").withColumn("verdict", verdict).drop("_uf_tokens", "_uf_label")


def labelled_pages(pages: DataFrame, labels: DataFrame, curated: Sequence[tuple[str, str]] = CURATED) -> DataFrame:
    """(url, label) to learn from: the verdict of the curated list where it speaks; else block or allow by the labels of the document
    whose number is the last directory or file of the path (block: of low quality, or toxic)."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("number")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    own = with_curated(with_parts(pages.select("url")), curated).withColumn("number", F.regexp_extract("path", "/([0-9]{1,18})[^/]*/?$", 1))
    both = own.join(known, "number", "left")
    label = F.coalesce("verdict", F.when(F.col("bad"), "block").when(~F.col("bad"), "allow"))
    return both.select("url", label.alias("label")).filter("label IS NOT NULL")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    taught = staged(labelled_pages(pages, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "url_labelled")
    return filtered(pages, taught).select("page_id", "host", "path", "rule", "verdict")


#: FP-growth's frequent sets by enumerating the subsets of every basket; the rest as above.
OP13_SQL = """
WITH cut AS (SELECT page_id, url, coalesce(contains(url, '://'), false) AS ok,
                    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, ok, url, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM cut),
curated(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
judged AS (SELECT p.*, string_split(host, '.') AS labels, string_split(path, '/')[-1] AS last,
                  (SELECT max_by(c.rule, length(c.rule)) FROM curated c WHERE (p.host = c.host OR ends_with(p.host, '.' || c.host)) AND starts_with(p.path, c.path)) AS rule,
                  (SELECT max_by(c.verdict, length(c.rule)) FROM curated c WHERE (p.host = c.host OR ends_with(p.host, '.' || c.host)) AND starts_with(p.path, c.path)) AS verdict FROM parts p),
valued AS (SELECT *, [{'r': 'scheme=', 'v': translate(string_split(url, '://')[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')},
  {'r': 'top=', 'v': CASE WHEN host <> '' THEN labels[-1] END},
  {'r': 'site=', 'v': CASE WHEN len(labels) >= 2 THEN labels[-2] || '.' || labels[-1] END},
  {'r': 'sub=', 'v': CASE WHEN len(labels) >= 3 THEN labels[1] END},
  {'r': 'dir=', 'v': CASE WHEN length(path) > 1 THEN regexp_extract(path, '^/*([^/]*)', 1) END},
  {'r': 'end=', 'v': CASE WHEN length(path) > 1 THEN CASE WHEN last = '' THEN '/' WHEN contains(last, '.') THEN string_split(last, '.')[-1] END END},
  {'r': 'query=', 'v': CASE WHEN query <> '' THEN array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1]))), '&') END},
  {'r': 'fragment=', 'v': CASE WHEN contains(rest, '#') THEN '#' END}] AS raw FROM judged),
tokened AS (SELECT page_id, host, path, rule, verdict, CASE WHEN ok THEN list_sort(list_transform(list_filter(raw, lambda x: x.v IS NOT NULL),
  lambda x: x.r || CASE WHEN length(x.v) > 64 THEN md5(x.v) ELSE x.v END)) ELSE [] END AS tokens FROM valued),
known AS (SELECT CAST(doc_id AS VARCHAR) AS number, max(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
taught AS (SELECT row_number() OVER () AS i, tokens, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS label
           FROM tokened LEFT JOIN known ON regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1) = number WHERE verdict IS NOT NULL OR bad IS NOT NULL),
size AS (SELECT count(*) AS n, coalesce(count(*) FILTER (label = 'block') > count(*) FILTER (label <> 'block'), false) AS block FROM taught),
subsets AS (SELECT label, list_filter(tokens, lambda x, k: (mask >> (k - 1)) & 1 = 1) AS ante FROM taught, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS u(mask)),
counted AS (SELECT ante, label, count(*) AS n FROM subsets GROUP BY ALL),
found AS (SELECT ante, label, n, n / sum(n) OVER (PARTITION BY ante) AS confidence FROM counted),
rules AS (SELECT * FROM found, size WHERE found.n >= ceil(0.005 * size.n) AND confidence >= 0.6),
sets AS (SELECT DISTINCT tokens FROM tokened WHERE verdict IS NULL),
best AS (SELECT tokens, arg_min(label, ROW(-confidence, -r.n, array_to_string(ante, chr(31)), label)) AS label FROM sets JOIN rules r ON list_has_all(tokens, ante) GROUP BY tokens)
SELECT page_id, host, path, rule, coalesce(verdict, label, CASE WHEN block THEN 'block' ELSE 'allow' END) AS verdict
FROM tokened LEFT JOIN best USING (tokens) CROSS JOIN size
"""
