"""Which event belongs to which claim: the best one-to-one allocation of a group's events, and what it allows to say.

All claims of a group are weighed together: an event can serve one claim only, and a claim may stay without. An allocation's total is the sum of
its edges, plus 10 for each two dated claims whose events come in the claims' order and minus 10 where they don't; among equal totals
the first in the order of claims and events counts, a claim without event last.

The search is exact for any number of claims and events. Shortest augmenting paths solve the sum of edges by itself; their potentials
tell for every edge what taking it costs at least, and bound every partial allocation of a search over claims in turn. The order of dates makes the
problem a quadratic one, so that search takes long where many claims of one group have nearly equal edges: key groups so that they hold
the claims of one season and opponent, an order, a day, and so grow in number and not in size. Where claims stand in their order and a group's sets of events are few
(``SETS``), the same allocations come from a table: what the claims from one on can add depends on which events are taken before it, not on by whom. The
smallest groups (``LISTED``) are solved many at once, by the totals of all their allocations.

A claim's margin is what the whole allocation loses, in edges, if the claim must not have its event. Claims with the same printed score, hints and edges
can't be told apart: none of them gets an event. Empty tables give no rows; a claim of a group without events is rejected; a null score
leaves claims apart; null orders and dates take no part in the order of dates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, perm

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The least edge, what order counts, and the margins and score that a confidence asks for.
FLOOR, ORDER, HIGH, MEDIUM, HIGH_SCORE = 45, 10, 8, 4, 55
#: Costs of a group from which on arrays are faster than lists.
FEW = 600
#: Choices of a group's claims, by the sets of events taken before, up to which they are tabled.
SETS = 1 << 20
#: Allocations of a group up to which all are listed, and how many totals are held at once.
LISTED, TOTALS = 20_000, 1 << 20


def shortest_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Assign every row a column of its own for the least sum (rows <= columns): (column of each row, potentials of rows, of columns), with
    cost - rows - columns >= 0 everywhere and 0 where assigned. Integers stay integers."""
    n, m = cost.shape
    far = np.iinfo(np.int64).max // 4 if cost.dtype.kind == "i" else np.inf
    rows, columns = np.zeros(n, cost.dtype), np.zeros(m, cost.dtype)
    owner = np.full(m, -1)
    for start in range(n):
        dist, before, done = np.full(m, far, cost.dtype), np.full(m, -1), np.zeros(m, bool)
        row, at, base = start, -1, 0
        while True:
            step = base + cost[row] - rows[row] - columns
            closer = ~done & (step < dist)
            dist[closer], before[closer] = step[closer], at
            nearest = int(np.argmin(np.where(done, far, dist)))
            base, at = dist[nearest], nearest
            if owner[at] < 0:
                break
            done[at] = True
            row = owner[at]
        rows[start] += base
        rows[owner[done]] += base - dist[done]
        columns[done] -= base - dist[done]
        while at >= 0:
            prior = before[at]
            owner[at] = start if prior < 0 else owner[prior]
            at = prior
    column = np.empty(n, np.int64)
    taken = np.flatnonzero(owner >= 0)
    column[owner[taken]] = taken
    return column, rows, columns


def few_paths(cost: list[list]) -> tuple[list[int], list, list]:
    """``shortest_paths`` over plain lists: the same steps in the same order, without the cost of an array for each, which is what small groups spend."""
    n, m = len(cost), len(cost[0]) if cost else 0
    rows, columns, owner = [0] * n, [0] * m, [-1] * m
    for start in range(n):
        dist, before, left, done = [None] * m, [-1] * m, list(range(m)), []
        row, at, base = start, -1, 0
        while True:
            of, own, nearest, least = cost[row], rows[row], -1, None
            for c in left:
                step, far = base + of[c] - own - columns[c], dist[c]
                if far is None or step < far:
                    dist[c], before[c] = step, at
                    far = step
                if least is None or far < least:
                    nearest, least = c, far
            base, at = least, nearest
            if owner[at] < 0:
                break
            left.remove(at)
            done.append(at)
            row = owner[at]
        rows[start] += base
        for c in done:
            rows[owner[c]] += base - dist[c]
            columns[c] -= base - dist[c]
        while at >= 0:
            prior = before[at]
            owner[at] = start if prior < 0 else owner[prior]
            at = prior
    column = [-1] * n
    for c, row in enumerate(owner):
        if row >= 0:
            column[row] = c
    return column, rows, columns


def paths(cost: list[list], kind: type) -> tuple[list[int], list, list]:
    """The assignment of least sum by ``few_paths`` or, from ``FEW`` costs on, over arrays."""
    if sum(map(len, cost)) <= FEW:
        return few_paths(cost)
    column, rows, columns = shortest_paths(np.array(cost, kind))
    return column.tolist(), rows.tolist(), columns.tolist()


def best_allocation(edges: np.ndarray | list[list[int]], order: list, dates: list, without: tuple[int, int] | None = None) -> tuple[list[int], int]:
    """(event of each claim or -1, sum of its edges) of the allocation with the largest total; ``without`` bars a claim from an event."""
    value = edges if isinstance(edges, list) else edges.tolist()
    claims, events = len(value), len(dates)
    if claims == 1:
        # no order among claims: the first of the largest edges, none last
        best, sum_ = -1, None
        for e, v in enumerate(value[0]):
            if (0, e) != without and (sum_ is None or v > sum_):
                best, sum_ = e, v
        return ([-1], 0) if sum_ is None or sum_ < 0 else ([best], sum_)
    cost = [[-v for v in row] + [0] * claims for row in value]
    if without:
        cost[without[0]][without[1]] = 1 + sum(map(sum, value))
    column, rows, columns = paths(cost, np.int64)
    top = -(sum(rows) + sum(columns))
    loss = [[c - own - at for c, at in zip(of, columns, strict=True)] for of, own in zip(cost, rows, strict=True)]
    loss = [[*row[:events], min(row[events:])] for row in loss]
    dated = [d is not None for d in dates]
    most = sum(dated)

    def turn(i: int, e: int, chosen: list[int]) -> int:
        """What the dates of a claim's event add to those chosen before it."""
        if e < 0 or not dated[e]:
            return 0
        own, day, sum_ = order[i], dates[e], 0
        for j, f in enumerate(chosen):
            if f >= 0 and dated[f]:
                sum_ += ORDER if (order[j] < own) == (dates[f] < day) else -ORDER
        return sum_

    first = [c if c < events else -1 for c in column]
    found: list[tuple[int, list[int]]] = [(sum(value[i][e] + turn(i, e, first[:i]) for i, e in enumerate(first) if e >= 0) - 1, [])]
    used, chosen, places = [False] * events, [], (*range(events), -1)

    def search(i: int, lost: int, turns: int, placed: int) -> None:
        if i == claims:
            sum_ = sum(value[j][e] for j, e in enumerate(chosen) if e >= 0) + turns
            if sum_ > found[0][0]:
                found[0] = (sum_, chosen.copy())
            return
        rest, row = claims - i - 1, loss[i]
        # the least loss that an event still to be tried may have: what all turns could make up for
        more = min(rest, most - placed)
        spare = top - lost + turns + ORDER * ((placed + 1) * more + more * (more - 1) // 2 + placed)
        for e in places:
            if spare - row[e] <= found[0][0] or e >= 0 and (used[e] or (i, e) == without):
                continue
            now, after = lost + row[e], turns + turn(i, e, chosen)
            have = placed + (e >= 0 and dated[e])
            more = min(rest, most - have)
            if top - now + after + ORDER * (have * more + more * (more - 1) // 2) <= found[0][0]:
                continue
            chosen.append(e)
            if e >= 0:
                used[e] = True
            search(i + 1, now, after, have)
            chosen.pop()
            if e >= 0:
                used[e] = False

    search(0, 0, 0, 0)
    return found[0][1], sum(value[j][e] for j, e in enumerate(found[0][1]) if e >= 0)


class Tables:
    """The allocations of claims in their order (``order`` doesn't fall): for each claim and each set of events taken before it the most that it and the claims behind it can
    add, and the first event that does. Claims of equal order weigh dates among themselves the other way round, so events of the same order are a set of their own."""

    def __init__(self, value: list[list[int]], order: list[int], dates: list):
        self.value, self.claims, self.events = value, len(value), len(dates)
        self.full = (1 << self.events) - 1
        self.dated = sum(1 << e for e, d in enumerate(dates) if d is not None)
        self.earlier = [0 if d is None else sum(1 << f for f, x in enumerate(dates) if x is not None and x < d) for d in dates]
        self.level = [i + 1 < self.claims and order[i + 1] == order[i] for i in range(self.claims)]
        self.known: list[dict[int, tuple[int, int]]] = [{} for _ in range(self.claims)]
        reached = [np.zeros(1, np.int64)]
        for i in range(self.claims - 1):
            after, free = self._after(i, reached[i])
            reached.append(np.unique(after[free]))
        behind = None
        for i in reversed(range(self.claims)):
            gain, (after, free) = self._gains(i, reached[i]), self._after(i, reached[i])
            if behind is not None:
                gain += behind[np.minimum(np.searchsorted(reached[i + 1], after), len(behind) - 1)]
            gain[~free] = np.iinfo(np.int64).min
            behind, first = gain.max(1), gain.argmax(1)
            self.known[i] = dict(zip(reached[i].tolist(), zip(behind.tolist(), np.where(first < self.events, first, -1).tolist(), strict=True), strict=True))

    def _after(self, i: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state behind each choice of a claim, none last, and whether it is free."""
        bits = np.array([*(1 << e for e in range(self.events)), 0], np.int64)
        used, level = states & self.full, states >> self.events
        after = used[:, None] | bits
        if self.level[i]:
            after |= (level[:, None] | bits) << self.events
        return after, used[:, None] & bits == 0

    def _gains(self, i: int, states: np.ndarray) -> np.ndarray:
        """What each choice of a claim adds by itself, none last."""
        count = lambda x: np.bitwise_count(x).astype(np.int64)
        level = states >> self.events
        older, before = (states & self.full) ^ level, np.array(self.earlier, np.int64)
        turns = ORDER * (count(level & self.dated) - count(older & self.dated))[:, None] + 2 * ORDER * (count(older[:, None] & before) - count(level[:, None] & before))
        dated = np.array([self.dated >> e & 1 for e in range(self.events)], np.int64)
        return np.concatenate([np.array(self.value[i], np.int64) + turns * dated, np.zeros((len(states), 1), np.int64)], 1)

    @staticmethod
    def fit(order: list[int], events: int) -> bool:
        """Whether claims stand in their order and the table stays small."""
        if events > 30:
            return False
        sets = [comb(events, k) for k in range(min(len(order), events + 1))]
        return all(a <= b for a, b in zip(order, order[1:], strict=False)) and (events + 1) * sum((len(order) - k) * n for k, n in enumerate(sets)) <= SETS

    def choices(self, i: int, state: int) -> list[tuple[int, int, int]]:
        """(what it adds by itself, event, state behind it) of each choice of a claim, none last. A state is the set of events taken, with those by claims of the next one's order once more above."""
        m, dated, earlier, row, same = self.events, self.dated, self.earlier, self.value[i], self.level[i]
        used, level = state & self.full, state >> m
        older = used ^ level
        turns = ORDER * ((level & dated).bit_count() - (older & dated).bit_count())
        out = []
        for e in range(m):
            bit = 1 << e
            if not used & bit:
                gain = row[e]
                if dated & bit:
                    before = earlier[e]
                    gain += turns + 2 * ORDER * ((older & before).bit_count() - (level & before).bit_count())
                out.append((gain, e, used | bit | (level | bit) << m if same else used | bit))
        out.append((0, -1, state if same else used))
        return out

    def best(self, without: tuple[int, int] | None = None) -> tuple[list[int], int]:
        """``best_allocation`` of the table's claims."""
        last, barred = without if without else (-1, -1)
        changed: list[dict[int, tuple[int, int]]] = [{} for _ in range(last + 1)]

        def fill(i: int, state: int) -> int:
            # The table without the bar tells how much a choice can come to; those that can't be best are left.
            behind = self.known[i + 1] if i + 1 < self.claims else None
            options = [(gain + behind[after][0] if behind else gain, e, after, gain) for gain, e, after in self.choices(i, state) if i < last or e != barred]
            options.sort(key=lambda o: -o[0])
            top, first = None, -1
            for most, e, after, gain in options:
                if top is not None and most < top:
                    break
                if i < last:
                    held = changed[i + 1].get(after)
                    most = gain + (held[0] if held else fill(i + 1, after))
                if top is None or most > top or most == top and e >= 0 and (first < 0 or e < first):
                    top, first = most, e
            changed[i][state] = (top, first)
            return top

        if without:
            fill(0, 0)
        state, chosen = 0, []
        for i in range(self.claims):
            e = (changed[i] if i <= last else self.known[i])[state][1]
            chosen.append(e)
            used, level = state & self.full, state >> self.events
            bit = 1 << e if e >= 0 else 0
            state = used | bit | (level | bit) << self.events if self.level[i] else used | bit
        return chosen, sum(self.value[i][e] for i, e in enumerate(chosen) if e >= 0)


@lru_cache(maxsize=64)
def every(claims: int, events: int) -> np.ndarray:
    """All allocations in the order of claims and events, one a row; none is ``events``, the last."""
    rows: list[tuple[int, ...]] = [()]
    for _ in range(claims):
        rows = [(*r, e) for r in rows for e in range(events + 1) if e == events or e not in r]
    return np.array(rows, np.intp).reshape(len(rows), claims)


def listed(claims: int, events: int) -> bool:
    """Whether a group has few enough allocations to list them all."""
    count = 0
    for k in range(min(claims, events) + 1):
        count += comb(claims, k) * perm(events, k)
        if count > LISTED:
            return False
    return True


def solve_alike(weights: np.ndarray, order: np.ndarray, days: np.ndarray) -> list[tuple[list, int, list]]:
    """Groups of as many claims and events each: (event of each claim or -1, sum of edges, for each claim without its event: its other event or -1 and the sum of edges). weights: group, claim, event; order: group, claim; days: group, event, negative without a date."""
    groups, n, m = weights.shape
    rows, out = every(n, m), []
    each = max(1, TOTALS // len(rows))
    for at in range(0, groups, each):
        value = np.concatenate([weights[at : at + each], np.zeros((len(weights[at : at + each]), n, 1), np.int64)], 2)
        own, day = order[at : at + each], days[at : at + each]
        here = np.arange(len(value))
        total = sum(value[:, i].take(rows[:, i], 1) for i in range(n))
        if n > 1:
            # what the dates of two events add if their claims come in this order
            pair = np.zeros((len(value), m + 1, m + 1), np.int64)
            dated = day >= 0
            pair[:, :m, :m] = np.where(day[:, :, None] < day[:, None, :], ORDER, -ORDER) * (dated[:, :, None] & dated[:, None, :])
            pair = pair.reshape(len(value), -1)
            for i in range(n):
                for j in range(i + 1, n):
                    total += pair.take(rows[:, i] * (m + 1) + rows[:, j], 1) * np.where(own[:, i] < own[:, j], 1, -1)[:, None]
        summed = lambda which: sum(value[here, i, which[:, i]] for i in range(n))  # noqa: E731, B023
        chosen = rows[total.argmax(1)]
        others = []
        for i in range(n):
            rest = rows[np.where(rows[:, i] == chosen[:, i, None], np.iinfo(np.int64).min, total).argmax(1)]
            others.append(list(zip(np.where(rest[:, i] < m, rest[:, i], -1).tolist(), summed(rest).tolist(), strict=True)))
        out += zip(np.where(chosen < m, chosen, -1).tolist(), summed(chosen).tolist(), map(list, zip(*others, strict=True)), strict=True)
    return out


def weighed(claims: list[dict], events: list[dict], edges: dict[tuple, int]) -> list[list[int]]:
    names = [e["event"] for e in events]
    return [[edges.get((h, e), 0) for e in names] for h in (c["hypothesis"] for c in claims)]


def solve(groups: list[tuple[list[dict], list[dict], list[list[int]]]]) -> list[tuple]:
    """For each group of claims, events and weights what ``allocate`` takes as solved: those of one size together, while their allocations can be listed."""
    out: list = [None] * len(groups)
    sizes: dict[tuple[int, int], list[int]] = {}
    for g, (claims, events, _) in enumerate(groups):
        sizes.setdefault((len(claims), len(events)), []).append(g)
    rank = {d: r for r, d in enumerate(sorted({e["date"] for _, events, _ in groups for e in events if e["date"] is not None}))}
    for (n, m), of in sizes.items():
        if n and listed(n, m):
            weights = np.array([groups[g][2] for g in of], np.int64).reshape(len(of), n, m)
            order = np.array([[-1 if c["ord"] is None else c["ord"] for c in groups[g][0]] for g in of], np.int64)
            days = np.array([[rank.get(e["date"], -1) for e in groups[g][1]] for g in of], np.int64).reshape(len(of), m)
            for g, found in zip(of, solve_alike(weights, order, days), strict=True):
                out[g] = found
    return out


def allocate(claims: list[dict], events: list[dict], edges: dict[tuple, int], weights: list[list[int]] | None = None, solved: tuple | None = None) -> list[dict]:
    """One group. A claim has hypothesis, ord, alike and competitions; an event has event, date, date_confidence, same_fragment, printed and competitions.
    weights and solved: what ``weighed`` and ``solve`` found, if they were asked."""
    order = [c["ord"] for c in claims]
    weights = weighed(claims, events, edges) if weights is None else weights
    alike = {}
    for i, c in enumerate(claims):
        if c["alike"] is not None:
            alike.setdefault((c["alike"], tuple(weights[i])), []).append(i)
    unclear = {i for same in alike.values() if len(same) > 1 for i in same}
    if solved:
        chosen, sum_, others = solved
        without = lambda i, e: others[i]
    else:
        ords, dates = [-1 if o is None else o for o in order], [e["date"] for e in events]
        table = Tables(weights, ords, dates) if len(claims) > 1 and Tables.fit(ords, len(events)) else None
        best = table.best if table else lambda barred=None: best_allocation(weights, ords, dates, barred)
        chosen, sum_ = best()

        def without(i: int, e: int) -> tuple[int, int]:
            other, rest = best((i, e))
            return other[i], rest

    out = []
    for i, (c, e) in enumerate(zip(claims, chosen, strict=True)):
        kept = e >= 0 and i not in unclear and weights[i][e] >= FLOOR
        row = {"hypothesis": c["hypothesis"], "candidate": None, "event": None, "decision": "rejected", "score": 0, "runner_up": 0, "margin": 0, "confidence": "low", "league": False}
        if kept:
            other, rest = without(i, e)
            event, score, margin = events[e], weights[i][e], max(0, sum_ - rest)
            sure = event["date"] is not None and event["date_confidence"] in ("high", "medium") and event["same_fragment"] and event["printed"]
            confidence = "high" if sure and margin >= HIGH and score >= HIGH_SCORE else "medium" if event["date"] is not None and margin >= MEDIUM else "low"
            row |= {"candidate": event["event"], "decision": "unresolved", "score": score, "runner_up": weights[i][other] if other >= 0 else 0, "margin": margin, "confidence": confidence, "league": bool(set(c["competitions"] or ()) & set(event["competitions"] or ()))}
        rest = [(x["event"], w) for x, w in zip(events, weights[i], strict=True) if w > 0 and x["event"] != row["candidate"]]
        row["alternatives"] = sorted(rest, key=lambda x: -x[1])[:3]
        out.append(row)
    accepted: set[int] = set()
    for i in sorted(range(len(claims)), key=lambda i: -1 if order[i] is None else order[i]):
        row = out[i]
        if row["confidence"] != "high":
            continue
        earlier = [j for j in range(len(claims)) if order[j] is not None and order[i] is not None and order[j] < order[i]]
        if row["league"] or all(j in accepted for j in earlier):
            row["decision"], row["event"] = "accepted", row["candidate"]
            accepted.add(i)
        else:
            row["confidence"] = "medium"
    return out


def allocated(hypotheses: DataFrame, events: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """The allocation of every group. hypotheses: hypothesis (string), ord (int), alike (string or null: what makes claims look the same) and competitions
    (array); events: event (string), date, date_confidence, same_fragment, printed (boolean) and competitions; edges: hypothesis, event, edge (int), as
    ``evidence.edge_scores`` gives them. Returns hypothesis, candidate, event (accepted ones), decision, score, runner_up, margin, confidence and
    the next best events. Each group becomes one row of arrays, so that groups spread over tasks by themselves."""
    listed = lambda df, name, *cols: df.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    h = listed(hypotheses, "_h", F.coalesce("ord", F.lit(-1)).alias("_n"), "hypothesis", "ord", "alike", "competitions")
    e = listed(events, "_e", "event", F.date_format("date", "yyyy-MM-dd").alias("date"), "date_confidence", F.coalesce("same_fragment", F.lit(False)).alias("same_fragment"), F.coalesce("printed", F.lit(False)).alias("printed"), "competitions")
    w = listed(edges, "_w", "hypothesis", "event", F.col("edge").cast("int").alias("edge"))
    rows = h.join(e, on, "left").join(w, on, "left")
    schema = T.StructType([rows.schema[c] for c in on] + list(T.StructType.fromDDL("hypothesis string, candidate string, event string, decision string, score int, runner_up int, margin int, confidence string, alternatives array<struct<event: string, score: int>>")))

    def cut(column: pa.ListArray, values: list) -> Iterator[list]:
        """The values of a column's structs, row by row."""
        at = 0
        for n in pc.list_value_length(column).to_pylist():
            yield values[at : at + (n or 0)]
            at += n or 0

    def lists(column: pa.ListArray) -> Iterator[list[dict]]:
        """The structs of each row of a column, read field by field."""
        flat = column.flatten()
        names = [f.name for f in flat.type]
        return cut(column, [dict(zip(names, r, strict=True)) for r in zip(*(flat.field(n).to_pylist() for n in names), strict=True)])

    def weights_of(column: pa.ListArray) -> Iterator[dict[tuple, int]]:
        flat = column.flatten()
        pairs = zip(*(flat.field(n).to_pylist() for n in ("hypothesis", "event")), strict=True)
        return map(dict, cut(column, list(zip(pairs, flat.field("edge").to_pylist(), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = list(to_arrow_schema(schema))[len(on) :]
        for batch in batches:
            sides = zip(lists(batch.column("_h")), lists(batch.column("_e")), weights_of(batch.column("_w")), strict=True)
            groups = [(claims, events, weighed(claims, events, edges)) for claims, events, edges in sides]
            made, at = [], []
            for i, ((claims, events, weights), solved) in enumerate(zip(groups, solve(groups), strict=True)):
                made += allocate(claims, events, {}, weights, solved)
                at += [i] * len(claims)
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in on]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([m[f.name] for m in made], f.type) for f in fields)], [*on, *(f.name for f in fields)])

    return rows.mapInArrow(run, schema)
