"""Lempel-Ziv fingerprints against a plain parse and plain sets."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import lempel_ziv as L


def plain_phrases(text: str) -> list[str]:
    seen, out, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            out.append(text[start:end])
            start = end
    return out


def plain_likeness(a: str, b: str) -> float:
    cut = lambda f: {f[i : i + L.DIGITS] for i in range(0, len(f), L.DIGITS)}
    x, y = cut(a), cut(b)
    both = sorted(x | y)[: L.SIGNS]
    return sum(s in x and s in y for s in both) / len(both) if both else 1.0


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 6))) for _ in range(60)]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 80, 400]))) for _ in range(n)]


def test_parse():
    r = random.Random(1)
    for text in [*texts(1, 60), "", "a", "aaaaaaaaaa", *("".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(200))]:
        seen: set[str] = set()
        ends = L.parse(text, 0, seen)
        assert [text[a:b] for a, b in zip([0, *ends], ends)] == plain_phrases(text)
        assert seen == set(plain_phrases(text))


def test_hash_is_of_the_piece_alone():
    a, b = "xxabcabc", "abc" * 900
    h = L.hashes(a, [2, 5, 8])
    assert h[1] == h[2] == L.hashes(b, [3, len(b)])[0] and h[0] != h[1]
    assert L.hashes("zzabc", [5], 2)[0] == h[1]
    many = {w for t in texts(3, 80) for w in plain_phrases(t)}
    assert len({int(L.hashes(w, [len(w)])[0]) for w in many}) == len(many)


def test_exact_likeness_of_small_sets():
    a, b = "abcabcabc", "abcabdabe"
    x, y = set(plain_phrases(a)), set(plain_phrases(b))
    assert plain_likeness(L.fingerprint(a), L.fingerprint(b)) == pytest.approx(len(x & y) / len(x | y))


def brute(rows):
    """Results by plain loops, for ids that differ."""
    out, rows = {}, sorted((d, t or "") for d, t in rows)
    for i, (d, t) in enumerate(rows):
        after, q = rows[(i + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        f, g, h = (L.fingerprint(x) for x in (t, edited, after))
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h))
    return out


@pytest.mark.parametrize("range_chars", [500, 10**9])
def test_with_edited(spark, range_chars):
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts(5, 90))] + [(10_001, None), (10_002, None), (10_003, "x" * 50_000)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(d, t, "r", "h", 1) for d, t in rows], "doc_id long, text string, range string, h string, follows int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in L.with_edited(docs, range_chars).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for d, row in want.items():
        assert got[d][:4] == row[:4] and got[d][4:] == pytest.approx(row[4:]), d


def test_edges(spark):
    schema = "doc_id long, text string"
    assert L.with_edited(spark.createDataFrame([], schema)).count() == 0
    one = L.with_edited(spark.createDataFrame([(3, "abcabcab")], schema)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcabc" + b"ab").hexdigest()
    empty = L.with_edited(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert [(r["n_chars"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in empty] == [(0, "", 1.0, 1.0)] * 2
    again = spark.createDataFrame([(1, "same text")] * 7 + [(1, "other"), (None, "no id"), (None, None), (2**62 + 1, "far"), (2**62 + 2, "farther")], schema)
    rows = L.with_edited(again, 4).collect()
    assert len(rows) == 12 and sum(r["doc_id"] == 1 for r in rows) == 8 and sum(r["near_next"] == 1.0 for r in rows if r["doc_id"] == 1) >= 6


def test_likeness_column(spark):
    pairs = [(L.fingerprint(a), L.fingerprint(b)) for a, b in zip(texts(7, 40), texts(8, 40))] + [("", ""), (None, "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.likeness(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r["s"] is None if r["a"] is None else r["s"] == pytest.approx(plain_likeness(r["a"], r["b"]))


def test_fingerprints(spark):
    docs = spark.createDataFrame([(1, "abab", 5), (2, None, 5), (3, "abab", 6)], "doc_id long, text string, fingerprint int")
    got = dict(L.fingerprints(docs).collect())
    assert got[1] == got[3] == L.fingerprint("abab") and got[2] == ""
