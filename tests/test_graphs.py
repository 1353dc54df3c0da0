"""The stored index and the neighbour graph: recall on the tables and on clusters, copies, odd vectors; exact search on ties."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.errors import StorageError
from quillspark.operators import neighbours, retrieval
from quillspark.operators.index import GraphIndex
from quillspark.operators.store import Collection

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def queries(v, rule="vec_id % 20 = 0"):
    return v.filter(rule).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_index_on_the_table(spark, tmp_path):
    """Two ingests; at least nine of ten true neighbours, and under a fifth of the rows scored."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    store = Collection(spark, str(tmp_path / "c"), key="vec_id", indexed=True)
    store.ingest(v.filter("vec_id % 2 = 0"))
    store.ingest(v)
    assert store.index.count() == store.count() == v.count()
    found = store.index.search(queries(v), 5).cache()
    exact = retrieval.search_many(v, queries(v), 5)
    hits = found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    assert hits >= 0.9 * exact.count()
    assert found.agg(F.avg("scored")).first()[0] < 0.2 * v.count()
    far = found.join(exact.select("query_id", "vec_id", F.col("score").alias("s")), ["query_id", "vec_id"]).agg(F.max(F.abs(F.col("s") - F.col("score")))).first()[0]
    assert far < 1e-9
    top = retrieval.indexed_search(v, list(v.filter("vec_id = 0").first()["embedding"]), 5, index=store.index).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0]["vec_id"] == 0 and abs(top[0]["distance"]) < 1e-6
    store.reset()
    assert Collection(spark, str(tmp_path / "c"), key="vec_id", indexed=True).index.count() == 0


def test_index_of_odd_rows(spark, tmp_path):
    rows = [(i, [1, i % 3, 2]) for i in range(50)] + [(100, None), (101, [0, 0, 0]), (102, [1, None, 2]), (103, [float("nan"), 0, 1])]
    index = GraphIndex(spark, str(tmp_path / "i"), "vec_id")
    with pytest.raises(StorageError):
        index.search(queries(table(spark, rows)))
    index.add(table(spark, []))
    index.add(table(spark, rows), shard_rows=16)
    assert index.count() == 50 and index.shards().count() > 1
    got = index.search(table(spark, [(1, [1, 0, 2])]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 4).collect()
    assert len(got) == 4 and all(abs(r["score"] - 1) < 1e-12 and r["vec_id"] % 3 == 0 for r in got)
    with pytest.raises(StorageError):
        index.add(table(spark, [(200, [1, 2])]))
    index.add(table(spark, [(300, [5, 0, 10])]), shard_rows=16)
    assert index.count() == 51
    # The shard of one row is taken into the next ones.
    index.add(table(spark, [(301, [5, 1, 10]), (302, [5, 2, 10])]), shard_rows=16)
    assert index.count() == 53 and index.shards().filter("n < 8").count() == 1 and index.shards().select(F.explode("keys")).distinct().count() == 53


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_descent_on_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    exact, found = retrieval.knn_graph(v, 3), retrieval.knn_graph(v, 3, approximate=True)
    assert exact.join(found, ["src", "dst"], "left_semi").count() >= 0.95 * exact.count()


def test_descent_of_copies(spark):
    """Copies of one vector have each other by their ids, however many; the others' neighbours are exact on so few rows."""
    r = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(40, 6)))] + [(1000 + i, [3, 0, 0, 0, 0, 0]) for i in range(400)] + [(2000, [1.5, 0, 0, 0, 0, 0]), (3000, None), (3001, [0] * 6)]
    got = {}
    for x in neighbours.nearest(table(spark, rows), 3).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    usable = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in rows if v is not None and np.any(v)]
    assert got.keys() == {i for i, _ in usable}
    for i, v in usable:
        assert got[i] == [j for _, j in sorted((-round(float(v @ w), 12), j) for j, w in usable if j != i)[:3]], i


def test_descent_widens_until_enough_is_found(spark):
    """Vectors without clusters, and a width that finds too few of their neighbours: the result is measured and the width doubled."""
    r = np.random.default_rng(11)
    x = r.normal(size=(700, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    score = u @ u.T
    np.fill_diagonal(score, -2)
    true = {(i, int(j)) for i in range(700) for j in np.argsort(-score[i])[:3]}
    v = table(spark, list(enumerate(x)))
    points = spark.createDataFrame([(i, [float(y) for y in w]) for i, w in enumerate(u)], "id long, v array<double>")
    narrow = neighbours.descend(points, 4, rounds=4)
    share = len(true & {(a["id"], a["nbr"]) for a in narrow.filter("n <= 3").collect()}) / len(true)
    assert share < 0.9 and abs(neighbours.recall(points, narrow, 3, 700) - share) < 1e-9 and abs(neighbours.recall(points, narrow, 3) - share) < 0.05
    got = {(a["query_id"], a["vec_id"]) for a in neighbours.nearest(v, 3, width=4, rounds=4).collect()}
    assert len(got) == 2100 and len(true & got) >= 0.96 * len(true)


def brute(rows, asked, k, method):
    out = {}
    for q, x in asked:
        def score(v):
            if v is None or None in v or len(v) != len(x):
                return None
            a, b = np.array(v, float), np.array(x, float)
            if method == "cosine":
                size = np.linalg.norm(a) * np.linalg.norm(b)
                return float(a @ b / size) if size else None
            return float(np.linalg.norm(a - b))
        scored = [(s is None, 0 if s is None else -round(s, 9) if method == "cosine" else round(s, 9), i) for i, v in rows if (s := score(v)) is None or True]
        out[q] = [i for _, _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("method", ["cosine", "euclidean"])
def test_search_many_of_odd_rows(spark, method):
    r = random.Random(8)
    rows = [(i, r.choice([[1, 2, 3], [2, 4, 6], [0, 0, 0], None, [1, None, 3], [r.random(), r.random(), r.random()]])) for i in range(300)]
    asked = [(i, v) for i, v in rows if i % 20 == 0 and v is not None and None not in v and (method == "euclidean" or any(v))]
    v = table(spark, rows).repartition(3)
    got = {}
    for x in retrieval.search_many(v, spark.createDataFrame([(i, [float(y) for y in w]) for i, w in asked], "query_id long, q array<double>"), 4, method, digits=9).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert got == brute(rows, asked, 4, method)
    few = table(spark, rows[:3] + [(900, None), (901, None)])
    assert retrieval.search_many(few, spark.createDataFrame([(i, [float(y) for y in w]) for i, w in asked[:2]], "query_id long, q array<double>"), 9, method).count() == 10


def test_equal_vectors_are_bounded(spark):
    v = spark.range(12_000).select(F.col("id").alias("vec_id"), F.array(*(F.lit(float(i)) for i in range(1, 17))).alias("embedding"))
    start = time.time()
    got = retrieval.search_many(v, queries(v), 4)
    assert {(r["rank"], r["vec_id"]) for r in got.select("rank", "vec_id").distinct().collect()} == {(i + 1, i) for i in range(4)}
    assert time.time() - start < 20


def test_tied_texts(spark):
    """A hundred texts that tie at nine digits: the smallest ids are the nearest."""
    rows = [(i, [1.0, 1e-12 * (i % 7), 0.5]) for i in range(100)]
    v = table(spark, rows)
    got = retrieval.search_many(v, spark.createDataFrame([(0, [1.0, 0.7, 0.5])], "query_id long, q array<double>"), 3, digits=9).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2]


def test_many_headings(spark):
    from quillspark.operators import spans

    heads = [spans.Section(f"h{i}", 10 * i, 10 * i + 10, 10 * i + 10, -1, 1, f"D > h{i}") for i in range(40_000)]
    starts, begin = [h.start for h in heads], time.time()
    assert all(spans.section_at("D", starts, heads, 10 * i + 3, 0, False) == f"D > h{i}" for i in range(40_000)) and time.time() - begin < 5


def test_ingest_leaves_stored_rows_in_place(spark, tmp_path):
    """The plan of an ingest has no exchange of the stored side; another session's view of the folder has the same rows."""
    v = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    store = Collection(spark, str(tmp_path / "c"))
    store.ingest(v.limit(2000))
    plan = store.fresh(v)._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin") :]
    sides = [line for line in stored.splitlines() if "Exchange" in line or "Scan parquet" in line]
    assert "LeftAnti" in stored and sum("Exchange" in s for s in sides) == 1 and "Bucketed: true" in stored, stored
    report = store.ingest(v)
    assert (report.loaded, report.inserted, report.skipped, report.count_after) == (3000, 1000, 2000, 3000)
    other = Collection(spark.newSession(), str(tmp_path / "c"))
    assert other.count() == 3000 and other.ingest(v.limit(10)).inserted == 0
    store.reset()
    assert store.count() == 0 and store.ingest(v).inserted == 3000


def test_columns_of_a_collection(spark, tmp_path):
    """Records may come with their columns in another order, or without some; unknown ones are refused."""
    store = Collection(spark, str(tmp_path / "c"))
    store.ingest(spark.createDataFrame([("a", 1, "x")], "chunk_id string, n int, t string"))
    store.ingest(spark.createDataFrame([("y", "b", 2)], "t string, chunk_id string, n int"))
    store.ingest(spark.createDataFrame([("c",)], "chunk_id string"))
    assert sorted(map(tuple, store.rows().select("chunk_id", "n", "t").collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", None, None)]
    with pytest.raises(StorageError):
        store.ingest(spark.createDataFrame([("d", 1)], "chunk_id string, other int"))
