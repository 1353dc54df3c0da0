"""Nearest vectors where codes can't tell rows apart: many rows in tight bunches, of which each has more than are reranked."""

import numpy as np
import pytest

from quillspark.llm import ann


@pytest.mark.parametrize("kind", ["bunches", "mixed"])
def test_every_nearest_is_found(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 3000, 32
    if kind == "bunches":
        x = rng.normal(size=(3, d))[rng.integers(0, 3, n)] + 1e-3 * rng.normal(size=(n, d))
    else:
        x = np.concatenate([rng.normal(size=(n // 2, d)), rng.normal(size=(1, d)) + 1e-4 * rng.normal(size=(n // 2, d))])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0"), sample_rows=1000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    u = ann.unit(x)
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -2
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(n), -s))[:5].tolist()
