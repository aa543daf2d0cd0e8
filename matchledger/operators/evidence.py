"""Weighing evidence: scores, dates by vote, clusters, links of hypotheses to events, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .allocation import paths

#: What each confidence of a date counts.
WEIGHTS = {"high": 3, "medium": 2, "low": 1}


def weighted(parts: list[tuple[Column, int]]) -> Column:
    """The sum of weights whose condition holds; a condition that is null doesn't."""
    total = F.lit(0)
    for condition, weight in parts:
        total = total + F.when(condition, weight).otherwise(0)
    return total


def voted_dates(evidence: DataFrame, group: str, date: str, confidence: str, score: str) -> DataFrame:
    """The date with the largest sum of confidence times score, how sure it is, and the dates that disagree. A date that
    more than one item gives and that isn't low counts as high."""
    weight = F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))[F.col(confidence)]
    votes = evidence.filter(F.col(date).isNotNull()).groupBy(group, date).agg(F.sum(weight * F.greatest(F.lit(1), F.col(score))).alias("weight"), F.max(weight).alias("_best"), F.count("*").alias("votes"))
    w = Window.partitionBy(group)
    nth = F.row_number().over(w.orderBy(F.desc("weight"), date))
    rows = votes.withColumns({"_nth": nth, "_dates": F.sort_array(F.collect_set(date).over(w))}).filter("_nth = 1")
    sure = F.when((F.col("votes") > 1) & (F.col("_best") > 1), "high").when(F.col("_best") == 3, "high").when(F.col("_best") == 2, "medium").otherwise("low")
    return rows.select(group, date, "weight", "votes", sure.alias("confidence"), (F.size("_dates") - 1).alias("others"))


def rank_discounted(evidence: DataFrame, group: list[str], score: str, key: str) -> DataFrame:
    """A cluster's score: the best in full, the i-th further one by i + 3; and the sum of the best three by rank."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key)
    rows = evidence.withColumn("_i", F.row_number().over(w) - 1)
    return rows.groupBy(*group).agg(
        F.round(F.sum(F.col(score) / F.when(F.col("_i") == 0, 1).otherwise(F.col("_i") + 3)), 6).alias("event_score"),
        F.round(F.sum(F.when(F.col("_i") < 3, F.col(score) / (F.col("_i") + 1))), 6).alias("combined"),
        F.count("*").alias("items"),
    )


def clustered(evidence: DataFrame, group: str, day: str, key: str, gap: int) -> DataFrame:
    """Dated evidence in clusters: a gap of more than ``gap`` days starts a new one."""
    w = Window.partitionBy(group).orderBy(day, key)
    fresh = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > gap).cast("int"), F.lit(1))
    rows = evidence.withColumn("_fresh", fresh)
    return rows.withColumn("cluster", F.sum("_fresh").over(w).cast("int")).drop("_fresh")


def decision(best: Column, second: Column, exact: Column, conflict: Column, floor: int = 45, margin: int = 15) -> Column:
    """What the evidence for a hypothesis allows to say."""
    return (
        F.when(best.isNull() | (best < floor), "not_found")
        .when(conflict, "conflict")
        .when(second.isNotNull() & (best - second < margin), "ambiguous")
        .when(exact, "confirmed")
        .otherwise("probable")
    )


#: What a fragment's kind counts, and what a hint of its date counts by confidence. Fixed values.
KINDS = {"article": 15, "result_list": 5, "fixture_list": -20, "standings": -20, "coupon": -20}
TEMPORAL = {"high": 12, "medium": 8, "low": 3}


def fragment_score(f: DataFrame) -> DataFrame:
    """Adds what a fragment proves for a hypothesis. f has kind, opponent_found, own_found, match_talk, score_matches (null
    without a printed score), competition_agrees, side_agrees and temporal (a confidence or null). A score counts only where both
    sides are named, a date only there or where a match is talked of; a score that differs never excludes."""
    both = F.col("opponent_found") & F.col("own_found")
    value = lambda c, of: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in of.items() for x in p)), F.col(c)), F.lit(0))
    named = F.when(both, 25).when(F.col("opponent_found") | F.col("own_found"), 8).otherwise(0)
    agrees = weighted([(F.col("match_talk"), 15), (both & F.col("score_matches"), 25), (F.col("competition_agrees"), 10), (F.col("side_agrees"), 10)])
    dated = F.when(both | F.col("match_talk"), value("temporal", TEMPORAL)).otherwise(0)
    return f.withColumns({"same_fragment": both, "evidence_score": value("kind", KINDS) + named + agrees + dated})


def edge_scores(hypotheses: DataFrame, events: DataFrame, on: list[str], floor: int = 45) -> DataFrame:
    """Hypotheses against the events of their group. hypotheses: hypothesis, scores (array of home, away), sides and
    competitions (arrays); events: event, score, date_confidence, same_fragment, printed (home, away, or null), side,
    competitions (array), article, items. An event without a fragment on both sides and without the score proves nothing, nor
    does one with an unsure date and a low score; edges below ``floor`` are left out."""
    h = hypotheses.select(*on, "hypothesis", "scores", F.col("sides").alias("_sides"), F.col("competitions").alias("_named"))
    e = events.select(*on, "event", "score", "date_confidence", "same_fragment", "printed", "side", "competitions", "article", "items")
    seen = F.col("printed").isNotNull()
    straight = F.coalesce(seen & F.exists("scores", lambda s: (s["home"] == F.col("printed.home")) & (s["away"] == F.col("printed.away"))), F.lit(False))
    turned = F.coalesce(seen & F.exists("scores", lambda s: (s["home"] == F.col("printed.away")) & (s["away"] == F.col("printed.home"))), F.lit(False))
    linked = F.col("same_fragment") | straight | turned
    unsure = ~(straight | turned) & (F.col("date_confidence") == "low") & (F.col("score") < 55)
    league = F.when(F.arrays_overlap("_named", "competitions"), 15).when(F.size("competitions") > 0, 10).otherwise(0)
    total = F.col("score") + F.when(straight, 20).when(turned, 15).otherwise(0) + weighted([(F.array_contains("_sides", F.col("side")), 10), (F.col("article"), 10), (F.col("items") > 1, 5)]) + league
    rows = h.join(e, on).filter(linked & ~F.coalesce(unsure, F.lit(False)))
    return rows.select(*on, "hypothesis", "event", F.round(total).cast("int").alias("edge")).filter(F.col("edge") >= floor)


def assign(score: dict[tuple[str, str], float], margin: float = 10.0) -> list[tuple]:
    """(hypothesis, event, score, state) of one group, from the scores of its hypotheses and events: one to one, for the largest sum, whatever the group's
    size; a negative score is worse than no event. An assignment is accepted if the hypothesis's next best event scores lower by ``margin`` at least."""
    people, events = sorted({h for h, _ in score}), sorted({e for _, e in score})
    # a column for each event, and one of cost 0 for each hypothesis that stays without
    barred = 1.0 + sum(map(abs, score.values()))
    cost = [[-score[h, e] if (h, e) in score else barred for e in events] + [0.0] * len(people) for h in people]
    column, _, _ = paths(cost, float)
    out = []
    for h, c in zip(people, column, strict=True):
        e = events[c] if c < len(events) else None
        rest = [score[h, x] for x in events if x != e and (h, x) in score]
        state = "rejected" if e is None else "accepted" if not rest or score[h, e] - max(rest) >= margin else "unresolved"
        out.append((h, e, None if e is None else score[h, e], state))
    return out


def assigned(edges: DataFrame, group: str = "grp", margin: float = 10.0) -> DataFrame:
    """``assign`` for every group: (grp, hypothesis, event, score, state). Choose groups that grow in number with the table, not in size. Each becomes one
    row, so that a task reads many at once."""
    kind = dict(edges.dtypes)[group]
    held = F.collect_list(F.struct("hypothesis", "event", F.col("score").cast("double").alias("score"))).alias("edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, held = [], 0, batch.column(1).flatten()
            edges_ = list(zip(zip(*(held.field(c).to_pylist() for c in ("hypothesis", "event")), strict=True), held.field("score").to_pylist(), strict=True))
            for g, n in zip(batch.column(0).to_pylist(), pc.list_value_length(batch.column(1)).to_pylist(), strict=True):
                rows += [(g, *made) for made in assign(dict(edges_[at : at + n]), margin)]
                at += n
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["grp", "hypothesis", "event", "score", "state"])

    return edges.groupBy(F.col(group).alias("grp")).agg(held).mapInArrow(run, f"grp {kind}, hypothesis string, event string, score double, state string")


def merged_snippets(parts: list[str], least: int = 24) -> str:
    """Snippets joined where one ends as the next begins, over ``least`` characters at least; else one per line."""
    out = ""
    for p in parts:
        if p in out:
            continue
        n = next((k for k in range(min(len(out), len(p)), least - 1, -1) if out.endswith(p[:k])), 0)
        out = out + p[n:] if n else f"{out}\n{p}" if out else p
    return out


def merged_pages(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The snippets of each page merged in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "text": [merged_snippets(list(p)) for p in f["parts"]]})

    kind = dict(rows.dtypes)[key]
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("parts"))
    return lists.mapInPandas(run, f"{key} {kind}, text string")
