"""Pooled token vectors do not depend on how texts are batched, and equal a plain loop."""

import math
import random

import numpy as np
import pytest

from quillspark.errors import RetrievalError
from quillspark.operators import embedding


def plain(text: str, most: int) -> list[float]:
    model = embedding.HashStates()
    ids = model.tokens(text)[0]
    ids = ids if len(ids) <= most else ids[: most - 1] + ids[-1:]
    rows = [[(i >> s & 255) / 255 - 0.5 for s in (24, 16, 8, 0)] for i in ids]
    mean = [sum(c) / len(rows) for c in zip(*rows)]
    n = math.sqrt(sum(x * x for x in mean))
    return [x / n for x in mean]


def test_batches_change_nothing():
    r = random.Random(1)
    texts = [" ".join(r.choice(["ab", "c", "Def", "g"]) for _ in range(r.choice([0, 1, 2, 9, 40, 300]))) for _ in range(80)]
    one = embedding.TokenModel("h", 4, embedding.HashStates, 64, batch_tokens=1).embed(texts)
    for size in (100, 5000, 10**6):
        assert embedding.TokenModel("h", 4, embedding.HashStates, 64, batch_tokens=size).embed(texts) == one
    back = embedding.TokenModel("h", 4, embedding.HashStates, 64).embed(texts[::-1])[::-1]
    assert back == one
    for t, v in zip(texts, one):
        assert v == pytest.approx(plain(t, 64), abs=1e-12)


def test_batches_have_a_bound():
    seen = []

    class Model(embedding.HashStates):
        def states(self, ids, mask):
            seen.append(ids.shape)
            assert (mask.sum(axis=1) >= 2).all()
            return super().states(ids, mask)

    m = embedding.TokenModel("bounded", 4, Model, 50, batch_tokens=120)
    m.embed(["a " * n for n in (1, 60, 3, 30, 2, 45, 0)])
    assert all(a * b <= 120 or a == 1 for a, b in seen) and sum(a for a, _ in seen) == 7


def test_info_dimension_and_zero():
    m = embedding.TokenModel("h", 4, embedding.HashStates, 5)
    assert m.token_info("one two three") == (5, 5, False, 13)
    assert m.token_info("one two three four") == (6, 5, True, 13)
    with pytest.raises(RetrievalError):
        embedding.TokenModel("other", 3, embedding.HashStates).embed(["x"])
    assert embedding.pooled(np.zeros((1, 3, 2)), [3]).tolist() == [[0.0, 0.0]]
