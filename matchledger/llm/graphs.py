"""Connected components of a graph of links, as rounds of joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether no node stands below two others, or below one and above another. What reaches the driver is one row at most."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.count("*").alias("n")).filter("below > 0 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of a link but its component's smallest, with that smallest node. Alternates
    stars around the smallest larger and smaller neighbours until nothing but stars is left; each round is staged."""
    edges = staged(_small_star(edges).distinct(), "links")
    while not _stars(edges):
        edges = staged(_small_star(_large_star(edges)).distinct(), "links")
    return edges
