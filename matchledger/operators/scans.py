"""Layout of scanned pages: columns from where words lie, lines inside them, running text.

Words come with page, word, x, y, width and height (``landed.scanned_words``). A page's columns are found in the coverage of its width:
stretches that few words cross part it. Coverage is kept as steps (where it changes, summed by Spark), never as one entry a
pixel, so a page may be as wide as it likes. Lines are read in one stream over sorted words, with one line in memory.

Words without a page, a place or letters have no layout and are left out; missing sizes count as 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The width of a step, the share of the median coverage that still is quiet, the least width of a gutter,
#: the share of the median height that words of one line may differ by, and the least such distance.
STEP, QUIET, GUTTER = 10, 0.15, 40
LINE_SHARE, LINE_LEAST, HEIGHT = 0.6, 4, 20


def _placed(words: DataFrame) -> DataFrame:
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < 1e15), F.col(c).cast("double"))
    rows = words.select("page", F.trim("word").alias("word"), *(number(c).alias(c) for c in ("x", "y")), *(F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("width", "height")))
    return rows.filter("page IS NOT NULL AND word <> '' AND x IS NOT NULL AND y IS NOT NULL")


def _upper_median(rows: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The value in the middle of each group (the upper of two), each value counted by a weight."""
    counted = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value))
    ranked = counted.withColumns({"_upto": upto, "_all": F.sum("_n").over(w)}).filter(F.col("_upto") > F.floor(F.col("_all") / 2))
    return ranked.groupBy(*keys).agg(F.min(value).alias("median"))


def columns(words: DataFrame, gutter: int = GUTTER) -> DataFrame:
    """(page, column, left, right) of every page, from left to right. A stretch of at least ``gutter`` between the outermost words,
    crossed by at most a seventh or so of the words that the median step is, or by one, parts two columns."""
    step = lambda c: F.floor(c / STEP).cast("long")
    placed = _placed(words)
    first, last = step(F.col("x")), step(F.col("x") + F.col("width"))
    ends = F.array(F.struct(first.alias("at"), F.lit(1).alias("d")), F.struct((last + 1).alias("at"), F.lit(-1).alias("d")))
    steps = placed.select("page", F.inline(ends)).groupBy("page", "at").agg(F.sum("d").alias("d"))
    by = Window.partitionBy("page").orderBy("at")
    runs = steps.select("page", "at", F.sum("d").over(by).alias("cover"), F.lead("at").over(by).alias("until")).filter("until IS NOT NULL")
    median = _upper_median(runs.filter("cover > 0"), ["page"], "cover", F.col("until") - F.col("at"))
    quiet = F.col("cover") <= F.greatest(F.lit(1.0), F.col("median") * QUIET)
    marked = runs.join(median, "page").withColumn("quiet", quiet)
    # neighbouring quiet runs form one stretch: they share the number of loud runs before them
    stretch = marked.withColumn("loud", F.count_if(~F.col("quiet")).over(by)).filter("quiet").groupBy("page", "loud").agg(F.min("at").alias("from"), F.max("until").alias("to"))
    edges = placed.groupBy("page").agg(F.min(first).alias("first"), (F.max(last) + 1).alias("end"))
    gutters = stretch.join(edges, "page").filter((F.col("from") > F.col("first")) & (F.col("to") < F.col("end")) & ((F.col("to") - F.col("from")) * STEP >= gutter))
    inner = gutters.select("page", F.inline(F.array(F.struct(F.col("from").alias("right"), F.lit(None).cast("long").alias("left")), F.struct(F.lit(None).cast("long").alias("right"), F.col("to").alias("left")))))
    outer = edges.select("page", F.inline(F.array(F.struct(F.lit(None).cast("long").alias("right"), F.col("first").alias("left")), F.struct(F.col("end").alias("right"), F.lit(None).cast("long").alias("left")))))
    at = inner.unionByName(outer).withColumn("at", F.coalesce("left", "right"))
    placed_ = Window.partitionBy("page").orderBy("at")
    pairs = at.withColumn("until", F.lead("right").over(placed_)).filter("left IS NOT NULL")
    nth = (F.row_number().over(Window.partitionBy("page").orderBy("left")) - 1).alias("column")
    return pairs.select("page", nth, (F.col("left") * STEP).alias("left"), (F.col("until") * STEP).alias("right"))


def lines(words: DataFrame, gutter: int = GUTTER) -> DataFrame:
    """(page, column, line, y, text) in reading order. A word belongs to the column that holds its middle; a line takes the words that
    lie no further below its first one than a good half of the page's median height, from left to right."""
    placed = _placed(words)
    middle = F.col("x") + F.col("width") / 2
    found = columns(words, gutter)
    tall = _upper_median(placed.filter("height > 0"), ["page"], "height", F.lit(1))
    reach = F.greatest(F.lit(float(LINE_LEAST)), F.coalesce("median", F.lit(float(HEIGHT))) * LINE_SHARE)
    rows = placed.join(found, "page").filter((middle >= F.col("left")) & (middle < F.col("right"))).join(tall, "page", "left")
    rows = rows.select("page", "column", "y", "x", "word", reach.alias("reach"))
    # the window asks for what reading needs, a page together and in order: the join by page gives the first, so that words are shuffled once
    nth = F.row_number().over(Window.partitionBy("page").orderBy("column", "y", "x", "word"))
    sorted_ = rows.withColumn("_nth", nth).select("page", "column", "y", "x", "word", "reach", "_nth")
    return sorted_.mapInArrow(_read_lines, f"page {dict(rows.dtypes)['page']}, column int, line int, y double, text string")


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of sorted words: a new page or column starts afresh, a word too far below the line's first one starts the next line."""
    at, among, top, nth, held, out = None, None, 0.0, -1, [], []
    names, kinds = ["page", "column", "line", "y", "text"], [pa.null(), pa.int32(), pa.int32(), pa.float64(), pa.string()]

    def close():
        if held:
            held.sort(key=itemgetter(0))
            out.append((at, among, nth, top, " ".join([w for _, w in held])))

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        kinds[0] = batch.schema.field(0).type
        for page, column, y, x, word, reach in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[:6]), strict=True):
            same = column == among and page == at
            if not same or abs(y - top) > reach:
                close()
                nth = nth + 1 if same else 0
                at, among, top, held = page, column, y, []
            held.append((x, word))
        if out:
            yield rows()
            out.clear()
    close()
    if out:
        yield rows()


def running_text(read: DataFrame) -> DataFrame:
    """(page, column, text): a column's lines joined, with words mended that a hyphen parts before a small letter."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    joined = F.regexp_replace(F.array_join(ordered, "\n"), r"-\n(?=\p{Ll})", "")
    return read.groupBy("page", "column").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))
