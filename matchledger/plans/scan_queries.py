"""Queries on the layout of pages: documents set in columns, as a scan would give their words, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import scans

#: Words of a page, of a column and of a line as they are set.
PAGE, COLUMN, LINE = 360, 120, 6


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document set in three columns, uneven in both directions, with a headline across each page."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("i", "word"))
    n, size = F.col("i").cast("long"), F.length("word")
    on_page, in_column = n % PAGE, n % COLUMN
    return words.select(
        (F.col("doc_id") * 100_000 + F.floor(n / PAGE)).alias("page"),
        "word",
        (100 + F.floor(on_page / COLUMN) * 700 + n % LINE * 100 + (n * 7919 + F.col("doc_id") * 31) % 10).cast("double").alias("x"),
        (80 + F.floor(in_column / LINE) * 34 + (n * 104_729 + F.col("doc_id") * 13) % 9).cast("double").alias("y"),
        F.when(on_page == 0, 1500).otherwise(F.least(size * 8, F.lit(90))).cast("double").alias("width"),
        (18 + size % 7).cast("double").alias("height"),
    )


SCAN_SQL = """
worded AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS ws FROM documents)),
scan AS (SELECT doc_id * 100000 + n // 360 AS page, word, CAST(100 + (n % 360) // 120 * 700 + n % 6 * 100 + (n * 7919 + doc_id * 31) % 10 AS DOUBLE) AS x,
                CAST(80 + (n % 120) // 6 * 34 + (n * 104729 + doc_id * 13) % 9 AS DOUBLE) AS y,
                CAST(CASE WHEN n % 360 = 0 THEN 1500 ELSE least(length(word) * 8, 90) END AS DOUBLE) AS width, CAST(18 + length(word) % 7 AS DOUBLE) AS height FROM worded)"""

COLUMNS_SQL = f"""{SCAN_SQL},
cover AS (SELECT page, b, count(*) AS c FROM (SELECT page, unnest(range(CAST(floor(x / 10) AS BIGINT), CAST(floor((x + width) / 10) AS BIGINT) + 1)) AS b FROM scan) GROUP BY ALL),
sheet AS (SELECT page, min(b) AS lo, max(b) AS hi, list_sort(list(c))[count(*) // 2 + 1] AS median FROM cover GROUP BY page),
every AS (SELECT page, lo, hi, median, unnest(range(lo, hi + 1)) AS b FROM sheet),
marked AS (SELECT e.*, coalesce(c, 0) <= greatest(1, median * 0.15) AS quiet FROM every e LEFT JOIN cover USING (page, b)),
runs AS (SELECT page, lo, hi, min(b) AS a, max(b) + 1 AS z FROM (SELECT *, b - row_number() OVER (PARTITION BY page, quiet ORDER BY b) AS g FROM marked) WHERE quiet GROUP BY page, lo, hi, g),
gutters AS (SELECT page, a, z FROM runs WHERE a > lo AND z <= hi AND (z - a) * 10 >= 40),
starts AS (SELECT page, z AS at FROM gutters UNION ALL SELECT page, lo FROM sheet),
stops AS (SELECT page, a AS at FROM gutters UNION ALL SELECT page, hi + 1 FROM sheet),
cols AS (SELECT s.page, CAST(row_number() OVER (PARTITION BY s.page ORDER BY s.at) - 1 AS INTEGER) AS "column", s.at * 10 AS "left",
                (SELECT min(t.at) FROM stops t WHERE t.page = s.page AND t.at > s.at) * 10 AS "right" FROM starts s)"""


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.columns(_scan(spark, sf_dir))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.lines(_scan(spark, sf_dir))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.running_text(scans.lines(_scan(spark, sf_dir)))


LINES_SQL = f"""{COLUMNS_SQL},
tall AS (SELECT page, list_sort(list(height))[count(*) // 2 + 1] AS h FROM scan WHERE height > 0 GROUP BY page),
laid AS (SELECT s.page, "column", y, x, word, greatest(4, 0.6 * coalesce(h, 20)) AS reach
         FROM scan s JOIN cols c ON s.page = c.page AND x + width / 2 >= "left" AND x + width / 2 < "right" LEFT JOIN tall t ON t.page = s.page),
ys AS (SELECT DISTINCT page, "column", y, reach FROM laid),
jumps AS (SELECT a.page, a."column", a.y, min(b.y) AS nxt FROM ys a LEFT JOIN ys b ON a.page = b.page AND a."column" = b."column" AND b.y > a.y + a.reach GROUP BY ALL),
anchors AS (SELECT page, "column", min(y) AS y, 0 AS line FROM ys GROUP BY page, "column"
            UNION ALL SELECT a.page, a."column", j.nxt, line + 1 FROM anchors a JOIN jumps j ON a.page = j.page AND a."column" = j."column" AND a.y = j.y WHERE j.nxt IS NOT NULL),
read AS (SELECT l.page, l."column", a.line, a.y, string_agg(word, ' ' ORDER BY x, l.y, word) AS text
         FROM laid l ASOF JOIN anchors a ON l.page = a.page AND l."column" = a."column" AND l.y >= a.y GROUP BY ALL)"""

DEFINED = {
    "page_columns": (page_columns, f"WITH RECURSIVE {COLUMNS_SQL} SELECT * FROM cols"),
    "page_lines": (page_lines, f"WITH RECURSIVE {LINES_SQL} SELECT * FROM read"),
    "page_text": (page_text, f"""WITH RECURSIVE {LINES_SQL}
SELECT page, "column", trim(regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY line), '-\\n([\\p{{Ll}}])', '\\1', 'g'), '\\s+', ' ', 'g')) AS text FROM read GROUP BY ALL"""),
}
