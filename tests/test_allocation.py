import itertools
import random
from datetime import date

import numpy as np
import pytest

from matchledger.operators import allocation, evidence

DAYS = [None, *(f"1963-{m:02d}-{d:02d}" for m in (5, 6) for d in (1, 9, 20))]


def every(claims, events):
    """All allocations in the order of claims and events, none last."""
    for chosen in itertools.product([*range(events), -1], repeat=claims):
        held = [e for e in chosen if e >= 0]
        if len(set(held)) == len(held):
            yield chosen


def enumerate_states(claims, events, edges):
    """What ``allocate`` promises, by listing every allocation."""
    n, m = len(claims), len(events)
    w = [[edges.get((c["hypothesis"], e["event"]), 0) for e in events] for c in claims]
    proof = lambda a: sum(w[i][e] for i, e in enumerate(a) if e >= 0)
    scored = []
    for a in every(n, m):
        total = proof(a)
        for i, j in itertools.combinations(range(n), 2):
            if a[i] >= 0 and a[j] >= 0 and (x := events[a[i]]["date"]) and (y := events[a[j]]["date"]):
                total += 10 if (claims[i]["ord"] < claims[j]["ord"]) == (x < y) else -10
        scored.append((total, a))
    scored.sort(key=lambda s: -s[0])
    best = scored[0][1]
    unclear = {k for i, j in itertools.combinations(range(n), 2) if claims[i]["alike"] and claims[i]["alike"] == claims[j]["alike"] and w[i] == w[j] for k in (i, j)}
    out, accepted = {}, set()
    for i in sorted(range(n), key=lambda i: claims[i]["ord"]):
        e = best[i] if i not in unclear and best[i] >= 0 and w[i][best[i]] >= 45 else None
        if e is None:
            out[claims[i]["hypothesis"]] = (None, None, "rejected", 0, 0, 0, "low")
            continue
        other = next(a for _, a in scored if a[i] != e)
        margin, event = max(0, proof(best) - proof(other)), events[e]
        high = event["date"] and event["date_confidence"] in ("high", "medium") and event["same_fragment"] and event["printed"] and margin >= 8 and w[i][e] >= 55
        raw = "high" if high else "medium" if event["date"] and margin >= 4 else "low"
        free = all(j in accepted for j in range(n) if claims[j]["ord"] < claims[i]["ord"]) or bool(set(claims[i]["competitions"]) & set(event["competitions"]))
        state = ("accepted", "high") if raw == "high" and free else ("unresolved", "medium" if raw != "low" else "low")
        if state[0] == "accepted":
            accepted.add(i)
        out[claims[i]["hypothesis"]] = (event["event"], event["event"] if state[0] == "accepted" else None, state[0], w[i][e], w[i][other[i]] if other[i] >= 0 else 0, margin, state[1])
    return out


def group(r, n, m):
    claims = [{"hypothesis": f"h{i}", "ord": i if r.random() < 0.8 else r.randrange(n), "alike": r.choice([None, "2-1", "2-1", "0-0"]), "competitions": r.choice([[], ["cup"], ["cup", "league"]])} for i in range(n)]
    events = [{"event": f"e{i}", "date": r.choice(DAYS), "date_confidence": r.choice(["high", "medium", "low"]), "same_fragment": r.random() < 0.8, "printed": r.random() < 0.8, "competitions": r.choice([[], [], ["cup"]])} for i in range(m)]
    level = r.choice([[0, 45, 60], [0, 50, 50, 50], list(range(45, 110))])
    return claims, events, {(c["hypothesis"], e["event"]): r.choice(level) for c in claims for e in events if r.random() < 0.7}


FIELDS = ("candidate", "event", "decision", "score", "runner_up", "margin", "confidence")


@pytest.mark.parametrize("seed", range(60))
def test_equals_enumeration(seed):
    r = random.Random(seed)
    n = r.randrange(1, 6)
    claims, events, edges = group(r, n, r.randrange(0, 8 if n < 5 else 6))
    got = {row["hypothesis"]: tuple(row[f] for f in FIELDS) for row in allocation.allocate(claims, events, edges)}
    assert got == enumerate_states(claims, events, edges)


def by_subsets(w, order, dates):
    """The largest total of all allocations, built a claim at a time."""
    states = {(): 0}
    for i in range(len(order)):
        after: dict = {}
        for chosen, sum_ in states.items():
            for e in (*range(w.shape[1]), -1):
                if e >= 0 and e in chosen:
                    continue
                turn = sum(10 if (order[j] < order[i]) == (dates[f] < dates[e]) else -10 for j, f in enumerate(chosen) if f >= 0 and e >= 0 and dates[f] and dates[e])
                after[(*chosen, e)] = sum_ + turn + (int(w[i, e]) if e >= 0 else 0)
        states = after
    return max(states.values())


@pytest.mark.parametrize("seed", range(3))
def test_larger_groups(seed):
    r = random.Random(seed)
    claims, events, edges = group(r, 5, 12)
    w = np.array([[edges.get((c["hypothesis"], e["event"]), 0) for e in events] for c in claims])
    order, dates = [c["ord"] for c in claims], [e["date"] for e in events]
    chosen, sum_ = allocation.best_allocation(w, order, dates)
    total = sum_ + sum(10 if (order[i] < order[j]) == (dates[chosen[i]] < dates[chosen[j]]) else -10 for i, j in itertools.combinations(range(5), 2) if chosen[i] >= 0 and chosen[j] >= 0 and dates[chosen[i]] and dates[chosen[j]])
    assert total == by_subsets(w, order, dates)


@pytest.mark.parametrize("seed", range(8))
def test_paths_of_any_size_are_optimal(seed):
    r = np.random.default_rng(seed)
    n, m = int(r.integers(1, 60)), 0
    m = n + int(r.integers(0, 60))
    cost = r.integers(-100, 100, (n, m))
    column, rows, columns = allocation.shortest_paths(cost)
    spare = cost - rows[:, None] - columns
    assert len(set(column.tolist())) == n and (spare >= 0).all() and (spare[np.arange(n), column] == 0).all()
    assert (columns <= 0).all() and (columns[np.setdiff1d(np.arange(m), column)] == 0).all()  # so no other assignment costs less


def test_groups_in_spark(spark):
    r = random.Random(4)
    made = {g: group(r, r.randrange(1, 5), r.randrange(0, 6)) for g in range(30)}
    for claims, _, _ in made.values():
        for i, c in enumerate(claims):
            c["ord"] = i
    h = spark.createDataFrame([(g, c["hypothesis"], c["ord"], c["alike"], c["competitions"]) for g, (cs, _, _) in made.items() for c in cs], "g int, hypothesis string, ord int, alike string, competitions array<string>")
    e = spark.createDataFrame([(g, x["event"], date.fromisoformat(x["date"]) if x["date"] else None, x["date_confidence"], x["same_fragment"], x["printed"], x["competitions"]) for g, (_, es, _) in made.items() for x in es], "g int, event string, date date, date_confidence string, same_fragment boolean, printed boolean, competitions array<string>")
    w = spark.createDataFrame([(g, *k, v) for g, (_, _, ws) in made.items() for k, v in ws.items()], "g int, hypothesis string, event string, edge int")
    got = {(row["g"], row["hypothesis"]): tuple(row[f] for f in FIELDS) for row in allocation.allocated(h, e, w, ["g"]).collect()}
    assert got == {(g, k): v for g, (cs, es, ws) in made.items() for k, v in enumerate_states(cs, es, ws).items()}
    assert allocation.allocated(h.limit(0), e, w, ["g"]).count() == 0


def test_small_groups_are_solved_over_lists_as_over_arrays(monkeypatch):
    r = random.Random(11)
    for _ in range(300):
        n, m = r.randrange(1, 6), r.randrange(5, 9)
        cost = [[r.choice([0, -50, -50, -60, r.randrange(-99, 0)]) for _ in range(m)] for _ in range(n)]
        assert allocation.few_paths(cost) == tuple(x.tolist() for x in allocation.shortest_paths(np.array(cost, np.int64)))
    groups = [group(r, r.randrange(1, 5), r.randrange(1, 7)) for _ in range(60)]
    monkeypatch.setattr(allocation, "FEW", 0)
    want = [allocation.allocate(*g) for g in groups]
    monkeypatch.undo()
    monkeypatch.setattr(allocation, "shortest_paths", None)
    assert [allocation.allocate(*g) for g in groups] == want


def test_small_groups_are_assigned_without_arrays(monkeypatch):
    r = random.Random(12)
    scores = [{(f"h{i}", f"e{j}"): r.choice([55.0, 60.0, -2.5, r.random() * 60]) for i in range(r.randrange(1, 5)) for j in range(r.randrange(1, 6))} for _ in range(80)]
    monkeypatch.setattr(allocation, "FEW", 0)
    want = [evidence.assign(s) for s in scores]
    monkeypatch.undo()
    monkeypatch.setattr(allocation, "shortest_paths", None)
    assert [evidence.assign(s) for s in scores] == want


def test_tables_hold_what_the_search_finds():
    r = random.Random(21)
    for _ in range(400):
        n, m = r.randrange(2, 5), r.randrange(0, 7)
        order, dates = sorted(r.randrange(-1, n) for _ in range(n)), [r.choice(DAYS) for _ in range(m)]
        value = [[r.choice([0, 0, 45, 50, 50, r.randrange(45, 110)]) for _ in range(m)] for _ in range(n)]
        assert allocation.Tables.fit(order, m)
        table = allocation.Tables(value, order, dates)
        for barred in [None, *((i, e) for i in range(n) for e in range(m))]:
            assert table.best(barred) == allocation.best_allocation(value, order, dates, barred)
    assert not allocation.Tables.fit([2, 1], 3) and not allocation.Tables.fit([1, 2], 31) and not allocation.Tables.fit(list(range(20)), 20)


@pytest.mark.parametrize(("listed", "sets"), [(allocation.LISTED, allocation.SETS), (30, allocation.SETS), (0, 0)])
def test_groups_solved_together_equal_enumeration(monkeypatch, listed, sets):
    monkeypatch.setattr(allocation, "LISTED", listed)
    monkeypatch.setattr(allocation, "SETS", sets)
    monkeypatch.setattr(allocation, "TOTALS", 500)
    r = random.Random(22)
    made = [group(r, r.randrange(1, 5), r.randrange(0, 6)) for _ in range(150)]
    weighed = [(c, e, allocation.weighed(c, e, w)) for c, e, w in made]
    solved = allocation.solve(weighed)
    assert any(s is not None for s in solved) == bool(listed)
    for (claims, events, edges), (_, _, weights), s in zip(made, weighed, solved, strict=True):
        got = {row["hypothesis"]: tuple(row[f] for f in FIELDS) for row in allocation.allocate(claims, events, {}, weights, s)}
        assert got == enumerate_states(claims, events, edges)


def test_all_allocations_are_listed_in_order():
    for n, m in [(1, 0), (2, 3), (3, 2)]:
        assert allocation.every(n, m).tolist() == [[m if e < 0 else e for e in a] for a in every(n, m)]


def test_lines_of_allocations_are_shuffled_before_they_are_spelled_out(spark):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = entry.queries()["allocations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)
