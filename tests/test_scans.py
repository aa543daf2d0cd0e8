import random

import pytest

from matchledger.operators import scans
from matchledger.sources import landed

SCHEMA = "page long, word string, x double, y double, width double, height double"


def brute(words):
    """Columns and lines of one page by a bucket at a time."""
    words = [(w.strip(" "), x, y, width or 0, height or 0) for _, w, x, y, width, height in words if w and w.strip(" ") and x is not None and y is not None]
    if not words:
        return [], []
    first, last = min(int(w[1] // 10) for w in words), max(int((w[1] + w[3]) // 10) for w in words)
    cover = {b: sum(int(w[1] // 10) <= b <= int((w[1] + w[3]) // 10) for w in words) for b in range(first, last + 1)}
    loud = sorted(c for c in cover.values() if c)
    least = max(1, loud[len(loud) // 2] * 0.15)
    edges, at = [first * 10], first
    while at <= last:
        end = at
        while end <= last and cover[end] <= least:
            end += 1
        if end > at and at > first and end <= last and (end - at) * 10 >= 40:
            edges += [at * 10, end * 10]
        at = max(end, at + 1)
    edges.append((last + 1) * 10)
    columns = list(zip(edges[::2], edges[1::2], strict=True))
    heights = sorted(w[4] for w in words if w[4] > 0)
    reach = max(4, 0.6 * (heights[len(heights) // 2] if heights else 20))
    lines = []
    for c, (left, right) in enumerate(columns):
        nth, top = -1, None
        for w in sorted((w for w in words if left <= w[1] + w[3] / 2 < right), key=lambda w: (w[2], w[1], w[0])):
            if top is None or w[2] - top > reach:
                nth, top = nth + 1, w[2]
                lines.append([c, nth, top, []])
            lines[-1][3].append((w[1], w[0]))
    return columns, [(c, n, y, " ".join(w for _, w in sorted(held, key=lambda h: h[0]))) for c, n, y, held in lines]


def page(r, number):
    kind = r.randrange(4)
    rows = []
    for _ in range(r.choice([1, 2, 40, 300])):
        x = {0: r.uniform(0, 900), 1: r.choice([0, 400, 800]) + r.uniform(0, 300), 2: float(r.randrange(0, 1000, 10)), 3: r.choice([50, 700]) + r.gauss(0, 60)}[kind]
        rows.append((number, r.choice(["ab", "c-", "  d ", "é", "", None]), r.choice([x, x, x, x, None]), float(r.randrange(0, 400, 3)), r.choice([0.0, 20.0, 75.5, None]), r.choice([None, 0.0, 9.0, 14.0, 22.0])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_layout_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pages = {n: page(r, n) for n in range(40)}
    df = spark.createDataFrame([w for p in pages.values() for w in p], SCHEMA).repartition(3)
    columns, lines = {n: [] for n in pages}, {n: [] for n in pages}
    for row in scans.columns(df).orderBy("page", "column").collect():
        columns[row["page"]].append((row["left"], row["right"]))
    for row in scans.lines(df).orderBy("page", "column", "line").collect():
        lines[row["page"]].append((row["column"], row["line"], row["y"], row["text"]))
    for n, words in pages.items():
        assert (columns[n], lines[n]) == brute(words), n


def test_far_words_missing_pages_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 1.0, 5.0, 9.0), (1, "a", 0.0, 1.0, 5.0, 9.0), (1, "b", 9e14, 1.0, 5.0, 9.0), (1, "b", 9e14, 1.0, 5.0, 9.0), (1, "c", float("nan"), 1.0, 5.0, 9.0), (None, "d", 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    assert [(r["column"], r["text"]) for r in scans.lines(df).orderBy("column").collect()] == [(0, "a a"), (1, "b b")]
    assert scans.lines(df.limit(0)).count() == 0 and scans.columns(df.limit(0)).count() == 0 and scans.running_text(scans.lines(df.limit(0))).count() == 0


def test_words_of_a_scan_become_running_text(spark):
    word = '<String CONTENT="{}" HPOS="{}" VPOS="{}" WIDTH="40" HEIGHT="10"{}/>'
    xml = "<TextLine>" + word.format("The", 0, 0, "") + word.format("chair", 50, 2, "") + word.format("second", 300, 1, "") + "</TextLine><TextLine>" + word.format("vice-", 0, 20, "") + word.format("col", 300, 21, "") + "</TextLine>"
    xml += "<TextLine>" + word.format("chair", 0, 40, "") + word.format("sup", 60, 40, ' SUBS_TYPE="HypPart1" SUBS_CONTENT="support"') + word.format("1918-", 300, 41, "") + "</TextLine>"
    xml += "<TextLine>" + word.format("port", 0, 60, ' SUBS_TYPE="HypPart2" SUBS_CONTENT="support"') + word.format("19", 300, 61, "") + "</TextLine>"
    words = landed.scanned_words(spark.createDataFrame([(5, xml)], "page int, xml string"), "page", "xml")
    got = scans.running_text(scans.lines(words)).orderBy("column").collect()
    assert [tuple(r) for r in got] == [(5, 0, "The chair vicechair support"), (5, 1, "second col 1918- 19")]


def test_words_are_not_shuffled_again_to_be_read(spark):
    """By page alone: joins and reading ask for the same."""
    plan = scans.lines(spark.createDataFrame([(1, "a", 0.0, 1.0, 5.0, 9.0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan
