"""The pipeline's near-duplicates against brute force over the five-word shingles of all pairs."""

import os
import random

import pytest

import corpus_pipeline
from quillspark.llm import simhash
from quillspark.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def stage():
    return dict(corpus_pipeline.STAGES)["near_duplicates"]


def kept_by_brute_force(rows):
    """Ids of (id, text) that stay: the smallest of each component of links at 0.8."""
    sets = {d: shingles(t) for d, t in rows}
    root, ids, holders = {d: d for d in sets}, sorted(sets), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in ids:
        for e in {e for s in sets[d] for e in holders.get(s, ())}:
            if jaccard(sets[d], sets[e]) >= 0.8:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d for d in ids if find(d) == d}


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(30):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        rows.append((10 * k, " ".join(words)))
        for j, edits in enumerate((1, 2, 3, 8), 1):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * k + j, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  words"), (1004, "other words")]
    expected = kept_by_brute_force(rows)
    assert {1002, 1004} <= expected and not {1001, 1003} & expected
    assert any((fingerprint(a) ^ fingerprint(b)).bit_count() > 3 for (d, a), (e, b) in zip(rows, rows[1:]) if d in expected and e not in expected)
    got = stage()(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r["doc_id"] for r in got.collect()} == expected


@pytest.mark.parametrize("size", [2048, 2])
def test_shards_that_are_cut_link_alike(spark, size):
    """A dense group of near copies, in whole shards and in shards of two sets of which every pair meets."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(rng.choices(base, k=60))) for k in range(10)] + [(200, rows[3][1]), (None, "")]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}
    for _ in sets:
        for d in sets:
            for e in sets:
                if jaccard(sets[d], sets[e]) >= 0.8:
                    root[d] = root[e] = min(root[d], root[e])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8, shard_size=size).collect()}
    assert got.pop(None) is None and got == root
    pairs = [jaccard(sets[d], sets[e]) for d in range(40) for e in range(d)]
    assert min(pairs) < 0.8 <= max(pairs)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), similarity=0.8).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stage_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in stage()(spark, docs, SF).collect()} == expected
