"""The interval join against plain loops over all pairs, and the whole query against SQL."""

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import intervals as I
from quillspark.llm import queries

EVER = float("inf")


def relation(a, b, c, d):
    start = "before" if a < c else "with" if a == c else "after"
    end = 0 if b > d else 1 if b == d else 2
    return {"before": ("contains", "finished_by", "overlaps"), "with": ("started_by", "equals", "starts"), "after": ("overlapped_by", "finishes", "during")}[start][end]


def brute(left, right):
    out: dict = {}
    for client, a, b in {(c, a, None if b is None else max(a, b)) for c, a, b in left if c is not None and a is not None}:
        for other, c, d, crc in right:
            if other != client or c is None:
                continue
            x, y = EVER if b is None else b, EVER if d is None else max(c, d)
            if a <= y and c <= x:
                key = (client, a, b, relation(a, x, c, y))
                n, slots, total = out.get(key, (0, 0, 0))
                out[key] = (n + 1, None if x == y == EVER else slots + min(x, y) - max(a, c) + 1, total + crc)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, seed):
    """Intervals over several shards, before 1970 too, many of one client."""
    r = random.Random(seed)

    def one():
        a = r.randint(-70, 130)
        return r.choice([1, 1, 1, 2, 3, None]), r.choice([a, a, a, a, a, None]), r.choice([None, a, a + r.randint(0, 3), a + r.randint(0, 90), a - 5])

    left, right = [one() for _ in range(260)], [(*one(), r.randint(0, 2**32 - 1)) for _ in range(220)]
    got = I.overlaps(spark.createDataFrame(left, "client long, a long, b long"), spark.createDataFrame(right, "client long, a long, b long, crc long"))
    assert {tuple(x)[:4]: tuple(x)[4:] for x in got.collect()} == brute(left, right)


def test_empty(spark):
    left, right = spark.createDataFrame([(1, 2, 3)], "client long, a long, b long"), spark.createDataFrame([], "client long, a long, b long, crc long")
    assert I.overlaps(left, right).count() == 0
    assert I.overlaps(left.limit(0), spark.createDataFrame([(1, 2, 3, 4)], right.schema)).count() == 0


def test_sessions(spark):
    """Runs of clicks over cells and days against a plain loop; gaps of exactly the bound, ties and repeated rows."""
    r, gap = random.Random(5), 100
    at = {c: sorted(r.choice([0, 0, 1, 50, 99, 100, 101, 250, 3000]) + r.randint(-4000, 9000) // 100 * 100 for _ in range(300)) for c in (1, 2)} | {3: list(range(0, 5000, 100))}
    clicks = [(c, t, r.random() < 0.3) for c, ts in at.items() for t in ts] + [(None, 5, True), (4, None, True), (5, -1, None), (5, -1, True)]
    want = Counter()
    for client in {c for c, t, _ in clicks if c is not None}:
        run: list = []
        for t, bad in sorted((t, bool(e)) for c, t, e in clicks if c == client and t is not None):
            if run and t - run[-1][0] > gap:
                want[client, run[0][0], run[-1][0], any(e for x, e in run if x == run[-1][0])] += 1
                run = []
            run.append((t, bad))
        if run:
            want[client, run[0][0], run[-1][0], any(e for x, e in run if x == run[-1][0])] += 1
    got = I.sessions(spark.createDataFrame(clicks, "client long, at long, error boolean").repartition(3), gap, day=7).collect()
    assert Counter(map(tuple, got)) == want


def test_timestamps(spark):
    df = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.999999' AS x, timestamp_ntz'2024-03-31 02:30:00.000001' AS y, timestamp'2024-03-31 02:30:00Z' AS z")
    got = df.select(I.micros(F.col("x"), "timestamp_ntz"), I.micros(F.col("y"), "timestamp_ntz"), I.micros(F.col("z"), "timestamp")).first()
    assert tuple(got) == (-1, 1711852200000001, 1711852200000000)
    assert spark.range(1).select(I.floored(F.lit(-1), 10), I.floored(F.lit(2**62 + 3), 2)).first()[:] == (-1, 2**61 + 1)


def tables(spark, sales, lines, clicks):
    s = spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at string, a int, client string").withColumn("sold_at", F.col("sold_at").cast("timestamp_ntz"))
    li = spark.createDataFrame(lines, "sale_id long, shipped_at string, at int").withColumn("shipped_at", F.col("shipped_at").cast("timestamp_ntz"))
    return s, li, spark.createDataFrame(clicks, "client_id long, ts string, kind string, shard int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_nulls_repeats_and_clashing_names(spark):
    sales = [(1, 7, "done", "2024-01-01 05:00:00", 0, "x"), (1, 7, "done", "2024-01-01 05:00:00", 0, "x"), (2, 7, None, "2024-01-01 00:00:00", 0, "x"), (3, None, "open", "2024-01-01 00:00:00", 0, "x"), (4, 7, "open", None, 0, "x"), (None, 7, "open", "2024-01-01 07:00:00", 0, "x")]
    lines = [(1, "2024-01-01 13:00:00", 0), (1, None, 0), (2, "2023-01-01 00:00:00", 0), (None, "2024-02-01 00:00:00", 0)]
    clicks = [(7, "2024-01-01 06:10:00", None, 0), (7, "2024-01-01 06:25:00", "view", 0), (7, None, "error", 0), (None, "2024-01-01 06:10:00", "error", 0)]
    got = Counter((r["sale_id"], r["relation"], r["n_pairs"], r["overlap_slots"]) for r in I.sales_by_sessions(*tables(spark, sales, lines, clicks)).collect())
    # One session, slot 1 of the day. Sale 1 goes from slot 0 to 2, the sale without an id starts with it and stays open.
    assert got == Counter({(1, "contains", 1, 1): 2, (None, "started_by", 1, 1): 1})
    assert I.sales_by_sessions(*tables(spark, sales, lines, [])).count() == 0
    assert I.sales_by_sessions(*tables(spark, [], [], clicks)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("sales", "sale_lines", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.execute(queries.SQL["op12_intervals"]).fetchall()
    got = [tuple(r) for r in queries.op12_intervals(spark, f"/root/testdata/{sf}").collect()]
    assert len(got) == len(want) and sorted(map(repr, got)) == sorted(map(repr, want))
