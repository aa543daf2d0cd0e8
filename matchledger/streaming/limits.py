"""Keyed state over time: a rate limiter over a sliding window, leases that expire, windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = "user_id long, event_id long, ts timestamp, allowed boolean"


def admitted(times: list[float], kept: list[float], most: int, window: float) -> tuple[list[bool], list[float]]:
    """For times in order, whether each is within ``most`` admitted ones in the window before it; rejected ones don't
    count. kept: admitted times from before."""
    out, kept = [], list(kept)
    for t in times:
        kept = [k for k in kept if t - k < window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


def limited(events: DataFrame, most: int = 5, window: float = 3600.0) -> DataFrame:
    """Verdicts for a finished table. What is held for a key is its recent admissions, ``most`` at the most; rows of a
    partition come sorted and stream through, so a key of any size fits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, []
        for f in frames:
            verdicts = []
            for u, t in zip(f["user_id"], f["ts"].astype("int64") / _UNIT.get(str(f["ts"].dtype), 1e9), strict=True):
                if u != user:
                    user, kept = u, []
                ok, kept = admitted([t], kept, most, window)
                verdicts += ok
            yield f.assign(allowed=verdicts)[["user_id", "event_id", "ts", "allowed"]]

    rows = events.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, VERDICTS)


_UNIT = {"datetime64[us]": 1e6, "datetime64[us, UTC]": 1e6, "datetime64[ms]": 1e3}


def limited_stream(events: DataFrame, most: int = 5, window: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """Verdicts for a stream: the admissions of a key are its state, dropped when the watermark leaves them behind."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (kept,) = state.get if state.exists else ([],)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        times = [t.timestamp() for t in rows["ts"]]
        ok, kept = admitted(times, list(kept), most, window)
        state.update((kept,))
        state.setTimeoutTimestamp(int(max(max(times, default=0) + window, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield rows.assign(allowed=ok)[["user_id", "event_id", "ts", "allowed"]]

    rows = events.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("user_id").applyInPandasWithState(run, VERDICTS, "kept array<double>", "append", "EventTimeTimeout")


def counted(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type in windows; works on streams, where the watermark closes a window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's events with less than ``gap`` between them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upserted(old: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """An append-only log's latest row per key after a batch; the same batch twice changes nothing."""
    both = old.unionByName(batch)
    columns = [c for c in both.columns if c not in key]
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(order, *[c for c in columns if c != order])).alias("_r"))
    return latest.select(*key, *(F.col(f"_r.{c}").alias(c) for c in columns)).select(*both.columns)


def leased(requests: DataFrame, window: float = 900.0) -> DataFrame:
    """Who gets a lease on an item when requests come in order: the first, and after it whoever asks once it ran out; the
    holder renews it. requests: item, user, ts (seconds), request_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, holder, until = None, None, 0.0
        for f in frames:
            out = []
            for r in f.itertuples():
                if r.item != item:
                    item, holder, until = r.item, None, 0.0
                ok = holder is None or r.ts >= until or r.user == holder
                if ok:
                    holder, until = r.user, r.ts + window
                out.append(ok)
            yield f.assign(granted=out)[["item", "request_id", "granted"]]

    kinds = dict(requests.dtypes)
    return requests.repartition("item").sortWithinPartitions("item", "ts", "request_id").mapInPandas(run, f"item {kinds['item']}, request_id {kinds['request_id']}, granted boolean")
