"""All rows against all: the same as a stated set of queries, with nothing through the driver; when neighbour descent ends in it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import neighbours, retrieval

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("method", ["cosine", "euclidean"])
@pytest.mark.parametrize("rows_of_a_block", [1, 40, 1024])
def test_all_rows_as_queries(spark, monkeypatch, method, rows_of_a_block):
    r = random.Random(4)
    rows = [(i, r.choice([[1, 2, 3], [2, 4, 6], [0, 0, 0], None, [1, None, 3], [1, float("nan"), 3], [1, 2], *[[r.random(), r.random(), r.random()]] * 9])) for i in range(260)]
    v = table(spark, rows).repartition(5)
    monkeypatch.setattr(retrieval, "SIDE_ROWS", rows_of_a_block)
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    as_rows = lambda df: sorted((a["query_id"], a["rank"], a["vec_id"], a["score"] if a["score"] is None else round(a["score"], 12)) for a in df.collect())
    want = as_rows(retrieval.search_many(v, asked, 4, method))
    assert want == as_rows(retrieval.search_all(v, 4, method)) == as_rows(retrieval.search_all(v, 4, method, side_bytes=400)) and len(want) == 4 * 260
    single = v.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert as_rows(retrieval.search_all(single, 4, method)) == as_rows(retrieval.search_many(single, asked.withColumn("q", F.col("q").cast("array<float>")), 4, method))
    assert retrieval.search_all(v.limit(0), 4, method).count() == 0


def test_exact_graph_keeps_vectors_from_the_driver(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = table(spark, list(enumerate(r.normal(size=(300, 8))))).localCheckpoint()

    def refused(*_):
        raise AssertionError("vectors go to the driver")

    monkeypatch.setattr(type(v), "toArrow", refused)
    monkeypatch.setattr(type(v), "toPandas", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    assert 450 < retrieval.knn_graph(v, 3).count() <= 900


def test_wide_rounds_give_way_to_all_pairs(spark, monkeypatch):
    """Where the rounds of the next width are more work than all pairs, these are compared, and all is found; else the width doubles."""
    r = np.random.default_rng(13)
    x = r.normal(size=(900, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    score = u @ u.T
    np.fill_diagonal(score, -2)
    true = {(i, int(j)) for i in range(900) for j in np.argsort(-score[i])[:3]}
    v = table(spark, list(enumerate(x)))
    widths, descend = [], neighbours.descend
    monkeypatch.setattr(neighbours, "descend", lambda points, width, **options: widths.append(width) or descend(points, width, **options))
    found = lambda: {(a["query_id"], a["vec_id"]) for a in neighbours.nearest(v, 3, width=4, rounds=3).collect()}
    assert found() == true and widths == [4]
    monkeypatch.setattr(neighbours, "COST", 0)
    widths.clear()
    assert len(true & found()) >= 0.95 * len(true) and widths[:2] == [4, 8]
