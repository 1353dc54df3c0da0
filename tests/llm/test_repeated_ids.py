"""Rows that repeat an id with another text are judged by their own text."""

import random

import corpus_pipeline


def test_clean_text_under_a_repeated_id_stays(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c), (4, c)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, b), (3, c)]
