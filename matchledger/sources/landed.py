"""Landed responses: JSON, HTML, XML and wikitext bodies that were fetched before and lie in files or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import links, plain_text


def cache_key(url: Column) -> Column:
    """The name under which a response is kept."""
    return F.sha2(url, 256)


def latest(responses: DataFrame, url: str, at: str) -> DataFrame:
    """The last response of each address; ties go to the smaller body."""
    others = [c for c in responses.columns if c != url]
    order = F.struct(F.col(at), *(F.col(c) for c in others if c != at))
    kept = responses.groupBy(url).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return kept.select(url, cache_key(F.col(url)).alias("cache_key"), "_r.*")


def items(responses: DataFrame, body: str, path: str, schema: str, *keep: str) -> DataFrame:
    """One row per element of the array at ``path`` of a JSON body, read with a fixed schema; elsewhere no row."""
    found = F.from_json(F.get_json_object(body, path), f"array<struct<{schema}>>")
    return responses.select(*keep, F.posexplode(found).alias("nth", "_x")).select(*keep, "nth", "_x.*")


def bindings(responses: DataFrame, body: str, *variables: str) -> DataFrame:
    """Rows of a SPARQL result in JSON, with the variables as columns; unbound ones are null."""
    schema = ", ".join(f"`{v}`: struct<value: string>" for v in variables)
    rows = items(responses, body, "$.results.bindings", schema)
    return rows.select(*(F.col(f"`{v}`.value").alias(v) for v in variables))


def discovered(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Targets that pages link to, with the number of pages and the first of them."""
    rows = pages.select(page, F.explode(F.array_distinct(links(F.col(html)))).alias("target"))
    return rows.groupBy("target").agg(F.count("*").alias("pages"), F.min(page).alias("first_page"))


def _inner(found: Column) -> Column:
    return F.transform(found, lambda c: F.trim(F.regexp_replace(plain_text(c), "\\s+", " ")))


def table_rows(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Cells of every row of every table that has no table inside: page, table, row, cells."""
    every = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(?is)<(?:{tag})\\b[^>]*>(.*?)</(?:{tag})\\s*>"), F.lit(1))
    tables = pages.select(page, F.posexplode(every(F.col(html), "table")).alias("table", "_t"))
    rows = tables.select(page, "table", F.posexplode(every(F.col("_t"), "tr")).alias("row", "_r"))
    return rows.select(page, "table", "row", _inner(every(F.col("_r"), "td|th")).alias("cells"))


def with_header(rows: DataFrame, page: str, *header: str) -> DataFrame:
    """Rows after the first one that has all header names, as columns of these names; other tables give no rows."""
    named = F.forall(F.array(*map(F.lit, header)), lambda h: F.array_contains(F.col("cells"), h))
    heads = rows.filter(named).groupBy(page, "table").agg(F.min("row").alias("_h"), F.min_by("cells", "row").alias("_names"))
    cell = lambda h: F.get(F.col("cells"), (F.array_position("_names", F.lit(h)) - 1).cast("int"))
    return rows.join(heads, [page, "table"]).filter("row > _h").select(page, "table", "row", *(cell(h).alias(h) for h in header))


def infobox(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Labelled values of a page: rows whose header cell stands before one value cell."""
    pattern = "(?is)<th\\b[^>]*>((?:(?!</?t[hdr]\\b).)*)</th\\s*>\\s*<td\\b[^>]*>((?:(?!</?t[hdr]\\b).)*)</td\\s*>"
    found = F.arrays_zip(*(_inner(F.regexp_extract_all(html, F.lit(pattern), F.lit(i))).alias(n) for i, n in ((1, "label"), (2, "value"))))
    return pages.select(page, F.posexplode(found).alias("nth", "_x")).select(page, "nth", F.col("_x.label").alias("label"), F.col("_x.value").alias("value"))


def scanned_words(pages: DataFrame, page: str, xml: str) -> DataFrame:
    """Words of pages from text recognition, by their attributes: page, line, nth, word, x, y, width, height, confidence. Of a word
    that a line end parts, the first half stands for the whole and the second is left out."""
    lines = pages.select(page, F.posexplode(F.regexp_extract_all(xml, F.lit("(?s)<TextLine\\b.*?</TextLine>"), F.lit(0))).alias("line", "_l"))
    tags = lines.select(page, "line", F.posexplode(F.regexp_extract_all("_l", F.lit("<String\\b[^>]*>"), F.lit(0))).alias("nth", "_s"))
    of = lambda name: F.nullif(F.regexp_extract("_s", f'\\b{name}="([^"]*)"', 1), F.lit(""))
    number = lambda name: of(name).try_cast("double")
    rows = tags.withColumn("_half", of("SUBS_TYPE")).filter("_half IS NULL OR _half <> 'HypPart2'")
    word = F.when(F.col("_half") == "HypPart1", F.coalesce(of("SUBS_CONTENT"), of("CONTENT"))).otherwise(of("CONTENT"))
    return rows.select(page, "line", "nth", plain_text(word).alias("word"), number("HPOS").alias("x"), number("VPOS").alias("y"), number("WIDTH").alias("width"), number("HEIGHT").alias("height"), number("WC").alias("confidence"))


def templates(pages: DataFrame, page: str, wikitext: str, name: str) -> DataFrame:
    """Uses of a wikitext template with their named parameters. A link inside stands for its label, a template inside
    for its last parameter."""
    flat = F.regexp_replace(wikitext, "\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]|]*)\\]\\]", "$1")
    flat = F.regexp_replace(flat, "(?<=[=|\\s])\\{\\{(?:[^{}|]*\\|)+([^{}|=]*)\\}\\}(?=\\s*[|}])", "$1")
    uses = F.regexp_extract_all(flat, F.lit(f"(?is)\\{{\\{{\\s*{name}\\s*\\|([^{{}}]*)\\}}\\}}"), F.lit(1))
    rows = pages.select(page, F.posexplode(uses).alias("nth", "_u"))
    pairs = F.filter(F.split("_u", "\\|"), lambda p: p.contains("="))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_replace(p, "^[^=]*=", "")))
    last = F.array_compact(F.transform(pairs, lambda p, i: F.when(~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: F.trim(F.substring_index(q, "=", 1)) == F.trim(F.substring_index(p, "=", 1))), entry(p))))
    return rows.select(page, "nth", F.map_from_entries(last).alias("parameters"))


def merged_hits(hits: DataFrame, issue: str, query: str, fragments: str) -> DataFrame:
    """Hits of several searches joined by issue: the queries that found it and its different fragments, in order."""
    rows = hits.select(issue, query, F.explode_outer(fragments).alias("_f"))
    return rows.groupBy(issue).agg(F.array_sort(F.collect_set(query)).alias("queries"), F.array_sort(F.collect_set("_f")).alias("fragments"))


def series_gaps(rows: DataFrame, series: str, number: str) -> DataFrame:
    """Numbers between the first and last of a series that are missing or stand twice."""
    held = rows.filter(F.col(number).isNotNull()).groupBy(series, number).agg(F.count("*").alias("_n"))
    every = held.groupBy(series).agg(F.explode(F.sequence(F.min(number), F.max(number))).alias(number))
    both = every.join(held, [series, number], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return both.filter("_n <> 1").select(series, number, F.when(F.col("_n") == 0, "missing").otherwise("repeated").alias("problem"))
