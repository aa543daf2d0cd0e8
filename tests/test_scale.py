"""What held on small tables only."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchledger.catalog import encounters
from matchledger.functions import text
from matchledger.operators import archive, identity, windows
from matchledger.plans import match_queries

from .test_oracle import DATA, rows


def test_merged_intervals_and_their_sql_agree_on_many_equal_spans(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT 0 AS o_custkey, DATE '1995-01-01' + CAST(hash(i * 7 + 1) % 5 AS INTEGER) * 40 AS o_orderdate FROM range(5000) t(i)")
    want = con.execute(match_queries.MERGE_SQL).fetchall()
    rows = spark.createDataFrame(con.execute("SELECT o_custkey, o_orderdate, o_orderdate + 30 FROM orders").fetchall(), "o_custkey int, start date, end date")
    got = windows.merged_intervals(rows, ["o_custkey"], "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("name", "first"), [("printed_offices", 12340), ("named_lineups", 10830), ("named_lineups", 12345670)])
def test_publications_of_many_suppliers(spark, tmp_path, name, first):
    """Numbers of suppliers that share their first four digits; a name with a word that is none of a name; lists longer than what is read."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    changed = {"supplier": f"s_suppkey + {first} AS s_suppkey", "lineitem": f"l_suppkey + {first} AS l_suppkey", "orders": "o_custkey % 40 AS o_custkey"}
    for table, column in changed.items():
        con.execute(f"COPY (SELECT * REPLACE ({column}) FROM '{DATA}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(tmp_path))
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_near_names_are_all_found_and_none_is_broadcast(spark):
    r = random.Random(5)
    names = [None, "", "a", *{"".join(r.choice("ab") for _ in range(r.choice((1, 2, 3, 4, 5, 8, 39, 40, 41, 42)))) for _ in range(150)}]
    names += [n[:i] + c + n[i + 1 :] for n in names if n and len(n) > 30 for i, c in ((7, ""), (20, "x"), (3, "yb"))]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    con = duckdb.connect()
    con.execute("CREATE TABLE n AS SELECT DISTINCT unnest(?) AS n", [[n for n in names if n is not None]])
    for most in (1, 2):
        got = identity.near_names(df, "name", most)
        want = con.execute(f"SELECT x.n, y.n, levenshtein(x.n, y.n) FROM n x JOIN n y ON x.n < y.n WHERE levenshtein(x.n, y.n) <= {most}").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "Broadcast" not in got._jdf.queryExecution().toString()
    customers = spark.range(1000).select(F.format_string("Customer#%09d", "id").alias("n"))
    assert identity._by_deletions(customers, 1).count() == 1000 * 27 // 2


def test_moves_are_held_against_records_in_few_joins(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "coordinate long, payload string")
    old, new = rows((1, "a"), (2, None), (3, "c"), (None, "n")), rows((-1, "a"), (-2, "b"), (-4, "d"))
    moves = spark.createDataFrame([(1, -1), (1, -1), (2, -2), (5, -5), (None, None), (None, None)], "origin long, target long")
    got = archive.moved(old, new, moves)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("origin_twice", "1"), ("origin_twice", None), ("target_twice", "-1"), ("target_twice", None), ("origin_unknown", "5"), ("origin_unknown", None), ("target_unknown", "-5"),
        ("target_unknown", None), ("not_moved", "3"), ("not_moved", None), ("not_explained", "-4"), ("payload_changed", "2"),
    ], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_looked_up_rows_are_not_grouped(spark):
    forms = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), ("z", None), (None, 4)], "form string, id long")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w"), (5, None)], "key long, said string")
    got = identity.cascade(rows, "key", [("first", "said", forms), ("second", "said", spark.createDataFrame([("w", 9), ("y", 2)], "form string, id long"))])
    assert sorted(map(tuple, got.select("key", "found", "level").collect())) == [(1, 1, "first"), (2, None, "ambiguous"), (3, None, "ambiguous"), (4, 9, "second"), (5, None, "none")]
    assert "Aggregate [key" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_one_nation_are_dealt_over_many_tasks(spark):
    assert encounters(spark, DATA, 7).rdd.getNumPartitions() >= 96


def test_texts_lose_their_marks_outside_of_python(spark):
    r = random.Random(3)
    given = ["".join(chr(r.choice((r.randrange(32, 0x250), r.randrange(0x300, 0x3000), r.randrange(0xAC00, 0xD000), r.randrange(0xF900, 0xFFFD), r.randrange(0x1D400, 0x1D500), r.randrange(0x2F800, 0x2FA00)))) for _ in range(r.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*given, "", None]], "t string").select("t", text.without_marks(F.col("t")).alias("a"), text.without_compatible_marks(F.col("t")).alias("b"))
    for t, a, b in df.collect():
        assert a == (t and "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))
        assert b == (t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")))
    assert "array_distinct" in df._jdf.queryExecution().optimizedPlan().toString()
