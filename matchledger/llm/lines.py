"""Line dedup (operator 10): windows of three consecutive lines, native DataFrame operations only.

A text is cut at line feeds. Each run of three consecutive lines is a window, unless all three are blank. A window
that also starts earlier (smaller doc_id, or the same document and an earlier line) covers its three lines, and
every covered line goes; windows are judged on the input. Texts of fewer than three lines have no window.

Null text stays null with no lines; an empty text has one empty line. A null doc_id comes before all others.
Rows with equal doc_id and different texts are separate documents, in the order of the text's hash; a row that
repeats doc_id and text gets the result of the first. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 3


def _windows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(_ld_w1, _ld_w2: 128 bits of a window's hash, _ld_doc, _ld_text, _ld_at) of every window."""
    lines = docs.select(F.col(id_column).alias("_ld_doc"), F.xxhash64(text).alias("_ld_text"), F.split(text, "\n").alias("_ld_lines"))
    lines = lines.filter(F.size("_ld_lines") >= WINDOW)

    def window(i):
        parts = [F.element_at("_ld_lines", i + j) for j in range(1, WINDOW + 1)]
        blank = F.lit(True)
        for p in parts:
            blank = blank & (F.length(F.trim(p)) == 0)
        return F.struct(i.alias("at"), F.xxhash64(*parts).alias("w1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("w2"), blank.alias("blank"))

    each = lines.select("_ld_doc", "_ld_text", F.inline(F.transform(F.sequence(F.lit(0), F.size("_ld_lines") - WINDOW), window)))
    return each.filter(~F.col("blank")).select(F.col("w1").alias("_ld_w1"), F.col("w2").alias("_ld_w2"), "_ld_doc", "_ld_text", F.col("at").alias("_ld_at"))


def covered(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(_ld_doc, _ld_text, _ld_starts, _ld_stops): the merged line ranges that later occurrences cover. Counting goes
    through partial sums, so a window that a third of the documents share is no larger than others; its
    occurrences meet their first one in a join that splits skewed keys."""
    each = _windows(docs, id_column, text)
    place = F.struct("_ld_doc", "_ld_text", "_ld_at")
    firsts = each.groupBy("_ld_w1", "_ld_w2").agg(F.min(place).alias("_ld_first"), F.count("*").alias("_ld_n")).filter("_ld_n > 1").drop("_ld_n")
    later = each.join(firsts, ["_ld_w1", "_ld_w2"]).filter(~place.eqNullSafe(F.col("_ld_first")))
    found = later.groupBy("_ld_doc", "_ld_text").agg(F.sort_array(F.collect_set("_ld_at")).alias("_ld_found"))
    at, n = F.col("_ld_found"), F.size("_ld_found")
    starts = F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > WINDOW))
    stops = F.transform(F.filter(at, lambda x, i: (i == n - 1) | (F.get(at, i + 1) - x > WINDOW)), lambda x: x + WINDOW)
    return found.select("_ld_doc", "_ld_text", starts.alias("_ld_starts"), stops.alias("_ld_stops"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with ``text`` reduced to the lines kept, and n_lines and n_removed (long) in place of
    columns with these names."""
    gone = covered(docs, id_column, text)
    out = docs.withColumn("_ld_key", F.xxhash64(text))
    out = out.join(gone, out[id_column].eqNullSafe(gone["_ld_doc"]) & (out["_ld_key"] == gone["_ld_text"]), "left").drop("_ld_doc", "_ld_text", "_ld_key")
    out = out.withColumn("_ld_lines", F.split(text, "\n"))
    lines = F.col("_ld_lines")
    rest = F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), "_ld_stops"), F.concat("_ld_starts", F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, b - a)))
    removed = F.aggregate(F.zip_with("_ld_starts", "_ld_stops", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    return out.select(
        *[F.when(F.col("_ld_starts").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c
            FROM lines, unnest(range(1, CAST(len(ls) - 1 AS BIGINT))) AS u(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth
           FROM windows WHERE length(trim(a, ' ')) + length(trim(b, ' ')) + length(trim(c, ' ')) > 0),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM ranked, (VALUES (0), (1), (2)) AS v(j) WHERE nth > 1),
each AS (SELECT doc_id, i, ls[i] AS line FROM lines, unnest(range(1, CAST(len(ls) + 1 AS BIGINT))) AS u(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text
         FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
