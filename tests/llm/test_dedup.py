import collections
import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from matchledger.llm import graphs, lines, near, suffixes

from .fixtures import clashing, documents, rows


def test_line_dedup_against_sql(spark):
    r = random.Random(4)
    data = [(i, "\n".join(r.choice(["a", "b", "c", "", " "]) for _ in range(r.randrange(9)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", data)
    want = sorted(c.sql(f"SELECT doc_id, text, n_lines, n_removed FROM ({lines.OP10_SQL})").fetchall())
    got = sorted(tuple(x) for x in lines.dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == want
    assert sum(x[3] for x in got) > 0


def test_line_dedup_odd_rows(spark):
    df = clashing(documents(spark))
    out = lines.dedup_lines(df)
    assert out.columns == [*[c for c in df.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    assert by[2][0]["text"] is None and by[2][0]["n_lines"] == 0
    assert by[3][0]["text"] == "" and by[6][0]["n_removed"] == 0
    assert by[7][0]["text"] == "" and by[7][0]["n_removed"] == 12
    assert by[None][0]["n_removed"] == 0 and by[14][0]["n_removed"] == 3  # no id comes first
    assert lines.dedup_lines(documents(spark, empty=True)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def brute_groups(docs, size, percent=80):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, s) for i, s in sorted(sets.items()) if s]
    for a, (i, s) in enumerate(items):
        for j, t in items[a + 1 :]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_groups_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(50)]
    docs = []
    for g in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 12, 40, 120]))]
        for _ in range(r.randrange(1, 9)):
            words = list(base)
            for _ in range(r.randrange(0, max(2, len(words) // 10))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append((len(docs) * 3 % 997, " ".join(words)))
    docs += [(2000, ""), (2001, None), (2002, " \n"), (2003, "")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    for size in (2, 5):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near.groups(df, size).collect()}
        assert got == brute_groups(docs, size)


def test_near_pairs_hidden_in_large_buckets(spark):
    """Pairs at 0.82 whose common words are a template's, among 400 texts around it at some 0.67."""
    r = random.Random(11)
    docs = []

    def copy(places):
        docs.append((len(docs), " ".join(f"own{len(docs)}-{k}" if k in places else f"t{k}" for k in range(100))))

    for g in range(380):
        copy(set(r.sample(range(100), 10)))
        if g % 19 == 0:
            copy({k for k in range(100) if f"t{k}" not in docs[-1][1].split()})
    order = r.sample(docs, len(docs))
    want = brute_groups(docs, 1)
    assert sum(c != i for i, (_, c) in want.items()) == 20
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near.groups(spark.createDataFrame(order, "doc_id long, text string").repartition(4), 1).collect()}
    assert got == want


def test_near_rounds_end_when_few_pairs_are_left(spark, monkeypatch):
    """Copies of one text that are too far from it and from each other, but meet in its buckets: each is held against few others."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    order = [(k, " ".join(w if r.random() < 0.87 else f"x{k}_{i}" for i, w in enumerate(base))) for k in range(400)]
    steps, staged = [], near.staged
    monkeypatch.setattr(near, "staged", lambda df, name: (steps.append((name, out := staged(df, name))), out)[1])
    got = {x["doc_id"]: x["component_id"] for x in near.groups(spark.createDataFrame(order, "doc_id long, text string").repartition(4), 1).collect()}
    held = [df.count() for name, df in steps if name == "pairs"]
    assert sum(held[1:-1]) <= 8 * near.CENTRES * len(order)
    sets = {k: set(t.split()) for k, t in order}
    links = [(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {k: k for k in sets}
    while any(want[a] != want[b] for a, b in links):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_near_odd_rows(spark):
    got = collections.defaultdict(list)
    for x in near.groups(documents(spark)).collect():
        got[x["doc_id"]].append(x)
    assert sum(map(len, got.values())) == len(rows())
    assert [x["component_id"] for x in got[6] + got[7] + got[8]] == [6, 6, 6]
    assert [x["kept"] for x in got[6] + got[7] + got[8]] == [True, False, False]
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert len(got[12]) == 2 and got[2][0]["n_shingles"] == 0 and got[2][0]["kept"]
    assert near.groups(documents(spark, empty=True)).count() == 0


def test_near_dedup_holds_every_text_of_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    order = [(1, a), (2, b), (2, a), (3, a + " z"), (4, b + " z"), (5, "alone in here"), (5, "quite another one"), (6, "alone in here"), (7, "quite another one"), (8, "no link"), (8, None)]
    got = near.groups(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 1).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["n_shingles"]} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)}
    assert len(got) == len(order)


def test_components(spark):
    pairs = [(i + 1, i) for i in range(0, 30)] + [(100, 90), (95, 100), (7, 3)]
    got = {r["u"]: r["v"] for r in graphs.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 95: 90, 100: 90}


def brute_strings(docs, length):
    out, seen = {}, set()
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = len(data), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()
    return out


def test_suffixes_against_brute_force(spark):
    r = random.Random(1)
    docs = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 300)))) for i in range(60)]
    docs += [(100, "a" * 500), (101, "ab" * 200), (102, None), (103, "abc" * 100 + "x" + "abc" * 50), (104, "é" * 200), (105, "")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    for length, gram, crowded in ((12, 4, 2048), (12, 4, 1), (20, 12, 2048)):
        got = {x["doc_id"]: tuple(x)[1:] for x in suffixes.dedup_strings(df, length, gram, crowded).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
        assert got == brute_strings(docs, length)


def brute_factors(texts, length, grouped):
    """Longest match of each start with an earlier one, by comparing all pairs."""
    places = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - length + 1)]
    out = []
    for k, (i, p) in enumerate(places):
        best = 0
        for j, q in places[:k]:
            if not grouped or i == j:
                n = 0
                while p + n < len(texts[i]) and q + n < len(texts[j]) and texts[i][p + n] == texts[j][q + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


def test_previous_factors_match_definition():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(6)] + [b"ab" * 30, b"a" * 40, b"\0" * 20, b"x", b"ab" * 30, b"abcdefg" * 5]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for length in (1, 5, 12):
        for group in (None, np.arange(len(texts))):
            starts, got = suffixes.previous_factors(data, bounds, length, group)
            assert starts.tolist() == [bounds[i] + p for i, t in enumerate(texts) for p in range(len(t) - length + 1)]
            assert got.tolist() == brute_factors(texts, length, group is not None)


def test_nearest_smaller():
    r = random.Random(2)
    for values in ([], [3], r.sample(range(500), 500), [*range(1, 300), 0], [*range(300, 0, -1)], [5, 4, *range(10, 200), 3, *range(300, 400), 2]):
        want = [max((j for j in range(i) if values[j] < v), default=-1) for i, v in enumerate(values)]
        assert suffixes.nearest_smaller(np.array(values, np.int64)).tolist() == want


def by_place(docs):
    """Documents in the operator's order, told apart by id and text, for brute_strings."""
    distinct = {(i, t or "") for i, t in docs}
    hashed = {x: h for x, h in zip(distinct, suffix_ties([t for _, t in distinct]), strict=True)}
    return sorted(distinct, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x], len(x[1].encode())))


def suffix_ties(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.xxhash64("t").alias("h")).collect()
    return [h for _, h in sorted((x["k"], x["h"]) for x in rows)]


def test_suffixes_without_or_with_repeated_ids(spark):
    r = random.Random(12)
    shared = ["".join(r.choice("abcdefgh ") for _ in range(160)) for _ in range(6)]
    docs = []
    for k in range(2000):
        own = "".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 3, 40, 150])))
        text = own + r.choice(shared)[r.randrange(20) :] + own[:30] if k % 9 == 0 else own
        docs.append((None if k % 3 else r.randrange(100), text))
    order = by_place(docs)
    got = {(x["doc_id"], x["n_bytes"], x["kept"].decode()) for x in suffixes.dedup_strings(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("doc_id", "n_bytes", "kept").collect()}
    want = brute_strings([(k, t) for k, (_, t) in enumerate(order)], suffixes.LENGTH)
    expected = {(i, want[k][0], want[k][3]) for k, (i, _) in enumerate(order)}
    assert {(i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in got} == expected


def test_periodic_texts_and_segments_of_long_ones(spark):
    r = random.Random(8)
    part = ["".join(r.choice("abcdefghijklmnop ") for _ in range(1 << 18)) for _ in range(3)]  # segments end every 2**19
    docs = [(1, "ab" * 900 + "z" + "ab" * 70), (2, "b" + "ab" * 300), (3, "abc" * 700), (4, "x" * 120), (5, ("k" * 40 + "12 ") * 30), (6, "".join(f"{i % 13}-{'q' * 35}" for i in range(60)))]
    docs += [(7, part[0][:-50] + part[1] + part[0][:999] + part[2]), (8, part[0][-400:] + part[1][:400])]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixes.dedup_strings(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute_strings(docs, suffixes.LENGTH)


def test_suffixes_odd_rows(spark):
    df = documents(spark)
    got = collections.defaultdict(list)
    for x in suffixes.dedup_strings(df).collect():
        got[x["doc_id"]].append(x)
    assert sum(map(len, got.values())) == len(rows())
    assert got[6][0]["n_removed"] == 0 and got[7][0]["n_removed"] == got[7][0]["n_bytes"]
    assert got[11][0]["n_removed"] == 799 and got[12][1]["n_removed"] == 0 and got[2][0]["n_bytes"] == 0
    kept = suffixes.deduped(clashing(df))
    assert kept.columns == clashing(df).columns
    left = {x["doc_id"] for x in kept.collect()}
    assert 7 not in left and {1, 2, 3, 4, 5, 6, None} <= left
    assert suffixes.dedup_strings(documents(spark, empty=True)).count() == 0
    assert suffixes.deduped(documents(spark, empty=True)).count() == 0
