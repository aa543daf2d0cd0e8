"""Exact top-k search by inner product (operator 4): block-at-a-time pruning.

A vector's components become integers floor(256 * x). Ranges of vec_id form shards of some thousand vectors, and a
shard's vectors stand in blocks of ``BLOCK``, each with a forward index (its integer matrix) and, for every dimension,
its largest and smallest value. A query adds up, over the dimensions, the most that a block's extremes allow; it takes
the blocks in falling order of these bounds, scores a whole block through its forward index, and stops when the next
bound is below its k-th best score. A bound that equals it is still scored, as ties go to the smaller vec_id.

First every query is held against its own shard, which gives it k candidates and a k-th best score to start from; then
against the other shards. Each (shard, part of the queries) is a group of bounded size for one task, so both sides travel
in blocks; the k best of each shard meet in a window by query.

Vectors that are null, or hold nulls or values that aren't finite, take no part, nor do rows without vec_id. Sums are exact
at any size: in floating point or 64 bits where they fit, else in Python's integers. A score beyond the range of a long
counts as the end of that range. Missing components count as 0. Rows that repeat a vec_id are vectors of their own: each is a candidate
for all other rows, and as a query each has its own k best. Other columns are ignored; without vectors there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

BLOCK = 128
#: Vectors of a shard and queries of a part, at most, and bytes of either.
SHARD = PART = 16384
GROUP_BYTES = 16 << 20
NONE = np.iinfo(np.int64).min


def finite(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v array<double>) of the vectors that take part; row numbers them."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf")))  # false for NaN, as NaN is largest
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def matrix(lists: list, width: int) -> np.ndarray:
    """Rows of double lists as a matrix, missing components 0."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), exactly: as longs, or as Python's integers where some value is large."""
    if not x.size or np.abs(x).max() < 1 << 52:
        return np.floor(256.0 * x).astype(np.int64)
    whole = np.array([int(e) * 256 if abs(e) >= 1 << 44 else math.floor(256.0 * e) for e in x.ravel().tolist()], object)
    return whole.reshape(x.shape)


def _blocks(vectors: DataFrame, shards: int, width: int, block: int) -> DataFrame:
    """vectors: row, vec_id, v and asks, whether it is a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId(), []

        def row() -> pa.RecordBatch:
            marks, ids, vectors, asks = zip(*held, strict=True)
            own = matrix(vectors, width)
            data = [pa.array([shard], pa.int64()), *(pa.array([x.tobytes()]) for x in (np.array(ids, "<i8"), own, own.max(0), own.min(0), np.array(asks, bool), np.array(marks, "<i8")))]
            held.clear()
            return pa.RecordBatch.from_arrays(data, ["shard", "ids", "rows", "most", "least", "asks", "marks"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "v", "asks")), strict=True):
                held.append(x)
                if len(held) == block:
                    yield row()
        if held:
            yield row()

    laid = vectors.repartitionByRange(shards, "vec_id", "row").sortWithinPartitions("vec_id", "row")
    return laid.mapInArrow(run, "shard long, ids binary, rows binary, most binary, least binary, asks binary, marks binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: by floating point where no sum can reach 2**53, and held within the range of a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.dtype != object and b.dtype != object else np.inf
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def search(ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, ...]], k: int, floor: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (vec_id, score) per query, with score NONE where there are fewer. ids: the queries' row numbers; blocks: (vec_ids, rows, most, least, row
    numbers), where a query leaves out the row of its own number; floor: for each query a score that k others are known to reach, below which nothing is wanted; seen takes the number of
    (query, block) pairs scored and of all of them."""
    best = np.full((len(ids), k), NONE)
    who = np.full((len(ids), k), np.iinfo(np.int64).max)
    floor = np.full(len(ids), NONE) if floor is None else floor
    most, least = (np.stack([b[i] for b in blocks]) for i in (2, 3))
    bounds = product(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), np.hstack([most, least]))
    order = np.argsort(bounds, axis=1, kind="stable")[:, ::-1]
    live, scored = np.arange(len(ids)), 0
    for turn in range(len(blocks)):
        at = order[live, turn]
        keep = bounds[live, at] >= np.maximum(best[live, -1], floor[live])
        live, at = live[keep], at[keep]
        if not len(live):
            break
        scored += len(live)
        for b in np.unique(at):
            rows = live[at == b]
            found = np.where(blocks[b][4] == ids[rows, None], NONE, product(queries[rows], blocks[b][1]))
            score = np.hstack([best[rows], found])
            name = np.hstack([who[rows], np.broadcast_to(blocks[b][0], found.shape)])
            by_name = np.argsort(name, axis=1, kind="stable")
            falling = np.argsort(~np.take_along_axis(score, by_name, 1), axis=1, kind="stable")  # ~x falls as x rises
            top = np.take_along_axis(by_name, falling[:, :k], 1)
            best[rows], who[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
    if seen is not None:
        seen.append((scored, bounds.size))
    return who, best


def _read(blocks: pa.Table, width: int) -> list[tuple[np.ndarray, ...]]:
    """(vec_ids, rows, most, least, row numbers) of each block, as integers."""
    ids, marks = ([np.frombuffer(x, "<i8") for x in blocks.column(c).to_pylist()] for c in ("ids", "marks"))
    rows, most, least = ([integers(np.frombuffer(x, np.float64).reshape(-1, width)) for x in blocks.column(c).to_pylist()] for c in ("rows", "most", "least"))
    return [(i, r, m[0], s[0], n) for i, r, m, s, n in zip(ids, rows, most, least, marks, strict=True)]


HITS = "row long, query_id long, shard long, vec_id long, score long"


def _hits(rows: np.ndarray, ids: np.ndarray, shards: np.ndarray, who: np.ndarray, score: np.ndarray) -> pa.Table:
    k, real = who.shape[1], score.ravel() != NONE
    return pa.table([pa.array(x) for x in (np.repeat(rows, k)[real], np.repeat(ids, k)[real], np.repeat(shards, k)[real], who.ravel()[real], score.ravel()[real])], HITS.replace(" long", "").split(", "))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK, shard: int = SHARD, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score: for each row where ``is_query`` (a condition on vec_id) holds, its k best others."""
    ready = staged(finite(vectors, id_column, vector).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    n, wide, asked = ready.agg(F.count("*"), F.max(F.size("v")), F.count_if("asks")).first()
    width = max(wide or 1, 1)
    room = max(1, GROUP_BYTES // (8 * width))
    shards, parts = max(1, -(-n // min(shard, room))), max(1, -(-asked // min(part, room)))
    blocks = staged(_blocks(ready, shards, width, block), "blocks")

    def at_home(group: pa.Table) -> pa.Table:
        own = _read(group, width)
        asks = [np.frombuffer(x, bool) for x in group.column("asks").to_pylist()]
        ids, rows = (np.concatenate([b[i][a] for b, a in zip(own, asks, strict=True)]) for i in (0, 4))
        queries = np.concatenate([b[1][a] for b, a in zip(own, asks, strict=True)])
        home = np.full(len(ids), group.column("shard")[0].as_py())
        return _hits(rows, ids, home, *search(rows, queries, own, k))

    def abroad(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _hits(*(np.zeros(0, np.int64),) * 3, *(np.zeros((0, k), np.int64),) * 2)
        rows, ids, floor = (left.column(c).to_numpy() for c in ("row", "vec_id", "floor"))
        who, score = search(rows, integers(matrix(left.column("v").to_pylist(), width)), _read(right, width), k, floor)
        return _hits(rows, ids, left.column("shard").to_numpy(), who, score)

    home = staged(blocks.groupBy("shard").applyInArrow(at_home, HITS), "home")
    known = home.groupBy("row").agg(F.first("shard").alias("home"), F.when(F.count("*") == k, F.min("score")).alias("floor"))
    queries = ready.filter("asks").join(known, "row", "left").select("row", "vec_id", "v", "home", F.coalesce("floor", F.lit(NONE)).alias("floor"))
    # A shard has the number of its partition; queries without a hit at home are alone there.
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    queries = queries.filter(~F.col("shard").eqNullSafe(F.col("home")))
    sent = blocks.drop("asks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = queries.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(abroad, HITS) if shards > 1 else home.limit(0)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return home.union(found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH ready AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ready q JOIN ready c ON q.vec_id % 50 = 0 AND q.i <> c.i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
