"""Similarities, searches, validation and the collection."""

import json

import numpy as np

import pytest
from pyspark.sql import functions as F

from quillspark.errors import RetrievalError, StorageError
from quillspark.functions import vectors as V
from quillspark.operators import retrieval
from quillspark.operators.embedding import HashEmbedder
from quillspark.operators.store import Collection
from quillspark.sources import files

PAIRS = [((1.0, 0.0), (0.0, 1.0), 0.0), ((1.0, 2.0, 3.0), (2.0, 4.0, 6.0), 1.0), ((1.0, 0.0), (-1.0, 0.0), -1.0), ((1.0, 1.0), (1.0, 0.0), 0.707107)]


@pytest.mark.parametrize("a,b,expected", PAIRS)
def test_cosine(spark, a, b, expected):
    df = spark.createDataFrame([(list(a), list(b))], "a array<double>, b array<double>")
    assert df.select(V.cosine_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("a,b,expected", [((0.0, 0.0), (3.0, 4.0), 5.0), ((1.0, 2.0, 3.0), (4.0, 6.0, 3.0), 5.0), ((1.0, 0.0), (0.0, 1.0), 1.414214)])
def test_euclidean(spark, a, b, expected):
    df = spark.createDataFrame([(list(a), list(b))], "a array<double>, b array<double>")
    assert df.select(V.euclidean_distance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected, abs=1e-6)


@pytest.fixture(scope="module")
def stored(spark):
    model = HashEmbedder(16)
    texts = [f"word{i} word{i % 3}" for i in range(12)]
    return spark.createDataFrame([(f"c{i:02d}", i, v) for i, v in enumerate(model.embed(texts))], "chunk_id string, ordinal int, embedding array<double>"), model


@pytest.mark.parametrize("k", [0, -1, 2.5, "5", True])
def test_bad_k(stored, k):
    with pytest.raises(RetrievalError):
        retrieval.retrieve(stored[0], "question", stored[1], k)


@pytest.mark.parametrize("question", ["", "   ", None])
def test_bad_question(stored, question):
    with pytest.raises(RetrievalError):
        retrieval.retrieve(stored[0], question, stored[1])


def test_bad_method_and_dimension(stored):
    with pytest.raises(RetrievalError):
        retrieval.retrieve(stored[0], "q", stored[1], method="dot_product")
    with pytest.raises(RetrievalError):
        retrieval.retrieve(stored[0], "q", HashEmbedder(8))


def test_both_methods_agree_on_unit_vectors(stored):
    got = retrieval.retrieve_all_methods(stored[0], "word1 word2", stored[1], 1000)
    a, b = ([(r["rank"], r["chunk_id"]) for r in got[m].orderBy("rank").collect()] for m in ("cosine", "euclidean"))
    assert len(a) == 12 and a == b
    assert a[0] == (1, a[0][1]) and [r for r, _ in a] == list(range(1, 13))


def test_graph_excludes_self(stored):
    edges = retrieval.knn_graph(stored[0].drop("ordinal"), 2, "chunk_id").collect()
    assert edges and all(e["src"] < e["dst"] for e in edges)


def record(**more):
    return json.dumps({"chunk_id": "c", "text": "t", "embedding": [0.5, 0.5], "embedding_model": None} | more)


BAD = [("{not json", "json"), (record(embedding=None), "list"), (record(embedding="x"), "list"), (record(embedding=["a", "b"]), "list"), (record(embedding=[1.0]), "length"), (record(embedding=[0.0, 0.0]), "values"), (record(embedding_model="other"), "model")]


@pytest.mark.parametrize("line,fault", BAD)
def test_stored_vectors_fail_fast(spark, tmp_path, line, fault):
    path = tmp_path / "v.jsonl"
    path.write_text(record() + "\n\n" + line + "\n")
    with pytest.raises(RetrievalError, match=f"line 3.*{fault}"):
        files.stored_vectors(spark, str(path), 2, "m")


def test_stored_vectors_read(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text(record() + "\n" + record(embedding=[1, 2], embedding_model="m") + "\n")
    assert [list(r["embedding"]) for r in files.stored_vectors(spark, str(path), 2, "m").orderBy("ordinal").collect()] == [[0.5, 0.5], [1.0, 2.0]]
    path.write_text("\n")
    with pytest.raises(RetrievalError):
        files.stored_vectors(spark, str(path), 2, "m")


def test_collection(spark, stored, tmp_path):
    rows = stored[0]
    c = Collection(spark, str(tmp_path / "store"))
    assert c.count() == 0
    first = c.ingest(rows.filter("ordinal < 11"))
    assert (first.loaded, first.inserted, first.skipped, first.count_after) == (11, 11, 0, 11)
    second = Collection(spark, str(tmp_path / "store")).ingest(rows)
    assert (second.inserted, second.skipped, second.count_after) == (1, 11, 12)
    with pytest.raises(StorageError):
        c.ingest(rows.union(rows))
    with pytest.raises(StorageError):
        Collection(spark, str(tmp_path / "store"), "euclidean")
    c.reset()
    assert c.count() == 0


def test_floors_pass_from_batch_to_batch():
    """What k rows of a task's earlier batch reach leaves out rows of later ones, and no one that is among the nearest (F16, F19)."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(4000, 16)), rng.normal(size=(50, 16))
    known = np.ones(len(q), bool)
    for method in ("cosine", "euclidean"):
        floor, found, passed = np.full(len(q), -np.inf), {}, []
        for at in range(0, len(x), 500):
            c, r, score = retrieval._nearest(x[at : at + 500], np.ones(500, bool), q, known, 5, method, None, floor)
            passed.append(len(c))
            for i, j, s in zip(c, r, score):
                found.setdefault(int(i), []).append((-s if method == "cosine" else s, int(j) + at))
        assert sum(passed[4:]) < 4 * 5 * len(q) / 2
        for i in range(len(q)):
            s = retrieval._scores(x, q[i][None], method)
            assert [j for _, j in sorted(found[i])[:5]] == np.argsort(-s if method == "cosine" else s)[:5].tolist()
