"""The multi-query search takes every vector whose id is divisible by 20."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_twentieth_vector_is_a_query(spark):
    due = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    got = entry.queries()["multi_query_topk"](spark, SF).collect()
    assert {r["query_id"] for r in got} == due and len(got) == 5 * len(due)
