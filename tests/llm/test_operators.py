"""The operators against brute force on small tables that hold nulls, empty and very long texts, ties, repeats and clashing columns."""

import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import ann, chat, decontaminate, langid, licences, lm, packing, pii, simhash, toxicity
from quillspark.llm.common import bounded_sample

RNG = random.Random(11)
VOCABULARY = ["the", "of", "and", "Zebra", "été", "straße", "niño", "quick,", "brown.", "fox", "jumps", "over", "lazy", "dog", "x"]
CLASH = "doc_row long, row_key long, key string, n int, fp long, root string, w string, score double"


def words(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


BASE = [words(60) for _ in range(12)]
TEXTS = [*BASE, BASE[0], BASE[0] + " tail", BASE[1].replace("fox", "cat", 1), "", None, " \n\t ", "!!!", "one", "one two", words(30_000), "a" * 5000, "tab\tand  blanks \n\n lines\r\n", "日本 emoji 😀 text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", *[None] * 8) for i, t in enumerate(TEXTS)] + [(None, BASE[2], None, *[None] * 8), (3, BASE[3], "fr", *[None] * 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id for each row; prints: (id, fingerprint) rows."""
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    least = {g: min((d for (d, _), x in zip(prints, group) if x == g and d is not None), default=None) for g in group}
    return [least[g] for g in group]


@pytest.mark.parametrize("shard,trees", [(2048, 10_000), (2048, 0), (3, 0)])
def test_simhash(docs, none, shard, trees):
    prints = [(d, brute_fingerprint(t)) for d, t in rows_of(docs)]
    expected = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True)]
    got = simhash.near_duplicates(docs, shard_size=shard, most_trees=trees)
    assert same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()], expected)
    assert simhash.near_duplicates(none).count() == 0


def test_links_within_the_radius(spark):
    rng = np.random.default_rng(3)
    start = [int(x) for x in rng.integers(0, 2**63, 20)]
    prints = set(start)
    for x in start:
        for n in (1, 2, 3, 4):
            y = x
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    prints = [(i, p) for i, p in enumerate(sorted(prints))]
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for _, p in prints], "fp long")
    for size, trees, edges in ((2048, 10_000, 10_000), (2048, 0, 0), (4, 0, 10_000)):
        root = {r["a"] % 2**64: r["b"] % 2**64 for r in simhash.components(simhash.links(df, shard_size=size, most_trees=trees), edges).collect()}
        groups = {}
        for i, p in prints:
            groups.setdefault(root.get(p, p), []).append(i)
        want = {}
        for (i, _), c in zip(prints, brute_components(prints), strict=True):
            want.setdefault(c, []).append(i)
        assert same(groups.values(), want.values())


def test_ann_copies_tie(spark):
    """Copies of a vector score alike to the last bit, so the smaller vec_id comes first."""
    rng = np.random.default_rng(5)
    copy = rng.normal(size=63).tolist()
    rows = [(i, copy if i % 3 else rng.normal(size=63).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    copies = [i for i in range(90) if i % 3]
    for r in ann.search(df, df.filter("vec_id in (1, 40, 88)"), k=7, lists=3, probe_share=1.0, slice_rows=11).groupBy("query_id").agg(F.expr("array_sort(collect_list(struct(rank, vec_id, score)))").alias("found")).collect():
        assert [x["vec_id"] for x in r["found"]] == [i for i in copies if i != r["query_id"]][:7]
        assert len({x["score"] for x in r["found"]}) == 1


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((300, 8)), rng.standard_normal((1, 8)) + 1e-3 * rng.standard_normal((100, 8))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)] + [(900, None, 0.0), (901, [0.0] * 8, 0.0), (902, [1.0, None] + [0.0] * 6, 0.0), (903, [float("nan")] * 8, 0.0), (904, [1.0], 0.0), (None, [1.0] * 8, 0.0), (5, [float(v) for v in x[5]], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    exact = np.concatenate([x, x[5:6]]).astype(float)
    ids = np.append(np.arange(400), 5)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    for share, least in ((1.0, 1.0), (0.8, 0.9)):
        hits = total = 0
        got = {}
        for r in ann.search(df, df.filter("vec_id % 20 = 0"), lists=12, probe_share=share, slice_rows=50, block_rows=4).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 400, 20))
        for q, found in got.items():
            s = exact @ exact[q]
            order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:5]
            found = sorted(found)
            assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
            hits += len({v for _, v, _ in found} & {int(ids[i]) for i in order})
            total += len({int(ids[i]) for i in order})
            if share == 1.0:
                assert np.allclose([sc for _, _, sc in found], s[order])
        assert hits / total >= least
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id < 2"), df.filter("vec_id = 0")).count() == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ann_recall_on_the_tables(spark, sf):
    """At least 0.9 of the five nearest rows by brute force, with the query's own parameters."""
    from quillspark.llm import queries

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no tables")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = ann.unit(np.stack([rows[i] for i in ids]))
    hits, found = 0, {}
    for r in queries.op1_ann(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == {i for i in rows if i % 50 == 0}
    for q, got in found.items():
        order = [int(i) for i in ids[np.argsort(-(x @ x[np.searchsorted(ids, q)]), kind="stable")] if i != q]
        hits += len(got & set(order[:5]))
    assert hits >= 0.9 * 5 * len(found)


def test_ann_takes_hot_copies_and_queries_of_one_id(spark):
    """A vector that a third of the rows hold costs no square; of two vectors of one query id the smaller is searched."""
    rng = np.random.default_rng(8)
    hot, other = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(600)] + [(3, hot)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(0, hot), (3, hot), (7, max(hot, other)), (7, min(hot, other))], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, asked, k=4, lists=4, probe_share=1.0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [3, 3, 3, 3] and got[3] == [0, 6, 9, 12] and len(got[7]) == 4
    x = ann.unit(np.array([v for _, v in rows]))
    q = ann.unit(np.array([min(hot, other)]))[0]
    best = sorted((-round(float(s), 12), i) for s, (i, _) in zip(x @ q, rows) if i != 7)[:4]
    assert got[7] == [i for _, i in best]


def test_lm(docs, none):
    own = [(d, [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]) for d, t in rows_of(docs)]
    count, total = {}, sum(len(w) for _, w in own)
    for _, w in own:
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                count[tuple(w[i : i + n])] = count.get(tuple(w[i : i + n]), 0) + 1

    def p(g):
        if len(g) == 1:
            return count[g] / total
        return count[g] / count[g[:-1]] if count[g] >= 2 else 0.4 * p(g[1:])

    expected = [(d, len(w), round(sum(np.log(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w))), 4)) for d, w in own]
    got = lm.score(docs, batch_chars=2000, range_words=5000)
    assert same([(r["doc_id"], r["n_words"], round(r["log_score"], 4)) for r in got.collect()], [(d, n, float(s)) for d, n, s in expected])
    assert lm.score(none).count() == 0


def test_alignment_against_a_loop():
    rng = random.Random(5)
    for _ in range(60):
        a, b = [[rng.randint(1, 5) for _ in range(rng.randint(3, 12))] for _ in range(2)]
        best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        (score, s, e), _ = decontaminate.align(np.array(a, np.uint64), [np.array(b, np.uint64), np.array([9], np.uint64)])
        assert score == best and 0 <= s <= e <= len(b)


def test_decontaminate(spark, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(24)]
    edited = [*item[:6], word(), *item[7:15], *item[16:24]]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, f"{filler(40)} {' '.join(item).upper()}. {filler(30)}"), (2, f"{filler(10)}\n{', '.join(edited)} {filler(9)}"), (3, filler(300)), (4, " ".join(item[:5]) + " " + filler(50)), (5, None), (6, ""), (None, " ".join(item)), (1, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (10, "the the the the the"), (11, "  "), (12, f"{item[3]}, {item[4]}"), (13, item[6])], "item_id long, text string")
    for blocks in (1000, 2):
        got = decontaminate.contaminated(docs, bench, rare_least=2, rare_share=0.0, block_items=blocks).collect()
        # The first text, twice under one id, holds 7, 12 and 13; the edited one lacks the seventh word.
        assert same([(r["doc_id"], r["item_id"]) for r in got], [(1, 7), (2, 7), (None, 7), (1, 12), (2, 12), (4, 12), (None, 12), (1, 13), (None, 13)])
        assert all(r["score"] == 1.0 and r["end"] - r["start"] == 14 - r["item_id"] for r in got if r["item_id"] > 7)
    best = {r["doc_id"]: r for r in got if r["item_id"] == 7}
    assert best[1]["score"] == 1.0 and 0.6 < best[2]["score"] < 1
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_gradients_by_differences():
    net = langid.BiGRU(3, hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.array([[65, 66, 67, 68], [97, 98, 65, langid.PAD]]).T, np.array([0, 2])

    def loss():
        logp, _ = net.forward(x)
        return -logp[:, y, np.arange(2)].mean()

    logp, kept = net.forward(x, keep=True)
    for k, g in net.backward(logp, y, kept).items():
        for at in {tuple(i) for i in np.argwhere(np.abs(g) > 1e-4)[:12].tolist()}:
            old, net.w[k][at] = net.w[k][at], net.w[k][at] + 1e-3
            up = loss()
            net.w[k][at] = old - 1e-3
            down = loss()
            net.w[k][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3, (k, at)


def brute_positions(net, data):
    """Each byte's distribution by a plain loop: its window is read from either end, one byte and one unit at a time."""
    w, h = {k: v.astype(float) for k, v in net.w.items()}, net.w["u"].shape[2]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    out = []
    for i in range(len(data)):
        # The window that labels byte i.
        if len(data) <= langid.WINDOW:
            start = 0
        else:
            step = langid.WINDOW - 2 * langid.CONTEXT
            start = max((k for k in range(0, len(data) - langid.WINDOW, step) if k == 0 or k + langid.CONTEXT <= i), default=0)
            if i >= len(data) - langid.WINDOW + langid.CONTEXT:
                start = len(data) - langid.WINDOW
        part, logits = data[start : start + langid.WINDOW], w["c"][:, 0].copy()
        for k, read in enumerate((part[: i - start + 1], part[: i - start - 1 if i > start else None : -1])):
            s = np.zeros(h)
            for byte in read:
                a, u = w["x"][k][:, byte], w["u"][k] @ s
                z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                n = np.tanh(a[2 * h :] + r * u[2 * h :])
                s = n + z * (s - n)
            logits += w["v"][k] @ s
        out.append(np.exp(logits) / np.exp(logits).sum())
    return np.array(out)


def test_every_byte_is_labelled():
    net = langid.BiGRU(3, hidden=4, seed=2)
    texts = ["a", "ab c", "der Hund läuft. " * 30, "日本 " * 57, ""]
    label = langid.Labeller(net, 3, rows=3)
    pooled = label.pooled(texts)
    for t, p in zip(texts, pooled, strict=True):
        data = t.encode()
        assert [(a, b) for _, a, b in langid.windows(data)] == [(a, b) for _, a, b in langid.windows(data) if a < b]
        own = label.positions(t)
        assert own.shape == (len(data), 3)
        if data:
            brute = brute_positions(net, data)
            assert np.allclose(own, brute, atol=1e-4) and np.allclose(p, brute.mean(axis=0), atol=1e-4)


def test_langid(docs, none, spark):
    rng = random.Random(2)
    kinds = {"aa": ["tion", "ing", "th"], "bb": ["ñó", "ción", "rr"], "cc": ["sch", "keit", "ü"]}
    text = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(k, rng.randint(2, 60)), k) for i, k in enumerate(rng.choices(list(kinds), weights=[9, 9, 1], k=240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net, names = langid.fit(df.filter("doc_id % 4 <> 0"))
    assert names == sorted(kinds)
    got = langid.predict(df.filter("doc_id % 4 = 0"), net, names).join(df, "doc_id")
    assert got.filter("lang_pred = lang").count() / got.count() > 0.95
    odd = langid.predict(docs.unionByName(spark.createDataFrame([(900, "½ ² ٣"), (901, "½ a")], "doc_id long, text string"), allowMissingColumns=True), net, names)
    assert odd.count() == docs.count() + 2
    und = {r["doc_id"] for r in odd.filter("lang_pred = 'und'").collect()}
    assert und == {i for i, t in enumerate(TEXTS) if not t or not any(c.isalpha() for c in t)} | {900}
    assert odd.filter("score < 0 or score > 1").count() == 0
    assert langid.predict(none, net, names).count() == 0
    empty, no = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty, no).collect()} == {"und"}


def test_risk_and_its_gradient():
    rng = np.random.default_rng(4)
    xp, xu, w, prior = rng.normal(1, 1, (20, 4)), rng.normal(0, 1, (50, 4)), rng.normal(size=4), 0.2
    for b, correct in ((-0.3, False), (-9.0, True)):
        loss = lambda z: np.log(1 + np.exp(-z))
        value = lambda v, c: (prior * loss(xp @ v + c).mean(), loss(-(xu @ v + c)).mean() - prior * loss(-(xp @ v + c)).mean())
        own, rest = value(w, b)
        if correct:  # unlabelled rows far from the positives: the estimate for negatives falls below zero
            xu = xu * 0 - 5 * w / (w @ w)
            own, rest = value(w, b)
            assert rest < 0
        got, gw, gb = toxicity.risk(w, b, xp, xu, prior)
        assert np.isclose(got, own + max(0, rest))
        target = (lambda v, c: -value(v, c)[1]) if correct else (lambda v, c: sum(value(v, c)))
        for j in range(4):
            e = np.eye(4)[j] * 1e-5
            assert np.isclose((target(w + e, b) - target(w - e, b)) / 2e-5, gw[j], atol=1e-5)
        assert np.isclose((target(w, b + 1e-5) - target(w, b - 1e-5)) / 2e-5, gb, atol=1e-5)


def test_toxicity(docs, none, spark):
    rng = random.Random(6)
    clean = [f"w{i}" for i in range(300)]

    def text(bad):
        n = rng.randint(20, 120)
        return " ".join("badword" + rng.choice("abc") if bad and rng.random() < 0.06 or bad and j == 0 else rng.choice(clean) for j in range(n))

    marks = [rng.random() < 0.15 for _ in range(600)]
    df = spark.createDataFrame([(i, text(m)) for i, m in enumerate(marks)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks) if i % 2] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(df.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.filter("doc_id % 4 = 0"), model).collect()}
    hit = [got[i] >= 0.3 for i in got if marks[i]]
    wrong = [got[i] >= 0.3 for i in got if not marks[i]]
    assert np.mean(hit) > 0.9 and np.mean(wrong) < 0.05
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    kept = toxicity.keep_clean(df.filter("doc_id % 4 = 0").withColumn("more", F.lit(1)), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] < 0.3} and kept.columns == ["doc_id", "text", "more"]


@pytest.mark.parametrize("windows,merge", [(32, 64), (1, 1)])
def test_packing(docs, none, windows, merge):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, windows=windows, merge=merge).collect()
    wanted = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for d, t in rows_of(docs)]
    spans = [(d, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for d, ids in wanted for s, n in [(0, len(ids))]]
    assert sum(p["length"] for p in pieces) == sum(s[2] for s in spans)
    by_doc = {}
    for d, ids in wanted:
        by_doc.setdefault(d, []).append(ids)
    for p in pieces:
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in by_doc[p["doc_id"]])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none, path).count() == 0


def test_words_by_ranks_are_the_tokenizers_ids():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in TEXTS] + ["it's we'll I'M\nnext 12,345 <|endoftext|> end", "x y z"]
    assert encode(texts) == [x + encode.end for x in encode.whole(texts)]


PHRASES = licences.PHRASES


def brute_base(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licences(docs, none, spark):
    notices = ["Licensed under CC BY-NC 4.0.", "x MIT\nLicense mit license", "gnu general public license " * 3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software", "the general public", "CC  by cc", "ÀMIT license"]
    more = spark.createDataFrame([(100 + i, f"{words(9)} {t}" if i % 2 else t) for i, t in enumerate(notices)] + [(200, None), (200, "mit license"), (None, "apache license")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "score", "w", "row_key").unionByName(more, allowMissingColumns=True)
    got = licences.scan(both).collect()
    expected = [(d, *brute_base(t)) for d, t in rows_of(both)]
    assert same([tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got], expected)
    label = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert label[100] == ("cc-by,cc-by-nc", 1.0) and label[103][0] == "mit" and label[103][1] >= 0.7 and label[104] == ("", 0.0)
    assert licences.scan(none).count() == 0


def brute_spans(text, texts, k=3, apart=3, close=0.7):
    """Best score of each label whose template stands in the text, by loops over diagonals."""
    w, out = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if x], {}
    for label, templates in texts.items():
        for t in map(str.split, templates):
            lines = {}
            for i in range(len(w) - k + 1):
                for j in range(len(t) - k + 1):
                    if w[i : i + k] == t[j : j + k]:
                        lines.setdefault(i - j, set()).add(j)

            def score(members):
                places = {j for d in members for j in lines[d]}
                low, high = min(d + min(lines[d]) for d in members), max(d + max(lines[d]) + k for d in members)
                return len({x for j in places for x in range(j, j + k)}) / max(len(t), high - low)

            for d in lines:
                best = max(score([d]), score([e for e in lines if abs(e - d) <= apart]))
                if best >= close:
                    out[label] = max(out.get(label, 0), best)
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_licence_spans_against_loops(spark, most):
    rng = random.Random(4)
    bsd, isc = licences.TEMPLATES["bsd"][0], licences.TEMPLATES["isc"][0]
    texts = [f"{bsd} " + "conditions are met " * 30, "conditions are met " * 12 + bsd, f"{isc} {isc[40:]}", "licensed under cc by " + "nc 4 0 " * 12, bsd, "are met " * 40]
    every = [t for x in licences.TEMPLATES.values() for t in x]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(every).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["edit"], w[at : at + 1] * 2, [w[at], "more"]])
                w = w or ["x"]
            parts.append(" ".join(w * rng.choice([1, 1, 2])))
        texts.append(" filler ".join(parts))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "row_key long, text string")
    got = {}
    for r in licences.spans(rows, most_grams=most).collect():
        own = got.setdefault(r["row_key"], {})
        own[r["label"]] = max(own.get(r["label"], 0), r["score"])
        assert r["end_word"] - r["first_word"] <= max(map(len, map(str.split, every))) + 6
    for i, t in enumerate(texts):
        want = brute_spans(t, licences.TEMPLATES)
        assert set(got.get(i, {})) == set(want) and all(abs(got[i][x] - want[x]) < 1e-9 for x in want), t
    assert got[0]["bsd"] == got[1]["bsd"] == 1.0 and got[2]["isc"] == 1.0 and got[3]["cc-by-nc"] == 1.0 and 5 not in got


#: Personal data outside the base patterns, and strings that only look like it.
YES = {
    "email": ["mail john.doe (at) example (dot) com now", "write to mary_k [at] mail7.example.org", "contact: ann.lee at uni-bonn dot de", "reach bob99 @ web.example.net please"],
    "ip": ["host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "login from fe80::1ff:fe23:4567:890a today", "server 00:1a:2b:3c:4d:5e answered"],
    "card": ["pay by 378282246310005 today", "card 3782 822463 10005 was charged"],
    "phone": ["call (030) 123 4567 now", "phone 030 1234 567", "tel 555-123-4567 or", "fax 0171/555 1234"],
    "account": ["account 123456789012 is closed", "iban number 370400440532013000 noted"],
    "secret": ['api key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "token: AbCdEf0123456789GhIjKlMnOpQrStUv", "key=" + "a1b2c3d4" * 30],
}
NO = {
    "email": ["look at example.com and", "we met at the station dot was there", "the dot at the end dot of it", "me at noon dot then"],
    "ip": ["at 12:30:45:10 it stopped", "ratio 1:2:3:4 holds", "c:::: end"],
    "card": ["order 1234567890123 shipped"],
    "phone": ["on 2021-05-06 we", "from 1999-2003 it", "on 06/05/2021 they", "for $555 1234 only", "1 234 567 people"],
    "account": ["about 123456 items", "000000000000 zeros"],
    "secret": ["verheitschverheitenschungen 1", "12345678901234567890123 digits", "abcdefghijklmnopqrstuvwxyz letters"],
}


def test_added_spans_by_precision_and_recall(docs, spark):
    """The classifier decides on candidates of every kind; learnt from unlabelled texts alone."""
    rows = [(k, t, y) for y, own in ((1, YES), (0, NO)) for k, texts in own.items() for t in texts]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.detect(df).collect()}
    hit = {y: [(k, t) for i, (k, t, z) in enumerate(rows) if z == y and f"{k}:" in found[i]] for y in (0, 1)}
    precision, recall = len(hit[1]) / (len(hit[0]) + len(hit[1])), len(hit[1]) / sum(map(len, YES.values()))
    print(precision, recall, "wrong:", hit[0], "missed:", [(k, t) for k, x in YES.items() for t in x if (k, t) not in hit[1]])
    assert precision >= 0.9 and recall >= 0.85
    assert all(any(k == x for x, _ in hit[1]) for k in pii.MORE)


def test_many_matches_in_one_text(spark):
    """20,000 matches and more in one text: time in proportion."""
    import time

    text = " ".join(f"some words and more a{i}@b.com" for i in range(30_000))
    df = spark.createDataFrame([(1, text + " ün😀d"), (2, "x")], "doc_id long, text string")
    start = time.time()
    assert {r["doc_id"]: r["n_email"] for r in pii.detect(df).collect()} == {1: 30_000, 2: 0}
    assert pii.redact(df).orderBy("doc_id").first()["text"] == re.sub(r"a[0-9]+@b.com", "[EMAIL]", text) + " ün😀d"
    assert time.time() - start < 40


def brute_pii(text):
    own = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in own.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_pii(docs, none, spark):
    import hashlib

    tricky = [
        "😀 a.b@c.de, x@y_z@w.org a@b.c@d.e.f 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 9999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111111111", "+1 (974) 555-3436 +12 345 +49 30 1234567.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" key: 9807915762804490', "@@ a@b .@. %@-.-", "1" * 5000, "a." * 3000 + "@", "x" * 4000 + "@y.z", "- 1-2 3-4 5-6 " * 200,
    ]
    rng = random.Random(9)
    tricky += ["".join(rng.choices("ab1234567890.@ -+()%_", k=rng.randint(5, 120))) for _ in range(150)]
    both = docs.select("doc_id", "text", "n", "score").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"), allowMissingColumns=True)
    got = pii.detect(both).collect()
    expected = []
    for d, t in rows_of(both):
        spans = brute_pii(t)
        expected.append((d, *(sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert same([tuple(r)[:6] for r in got], expected)
    base = {d: brute_pii(t) for d, t in rows_of(both)}
    assert all(r["spans"].split(",")[: len(base[r["doc_id"]])] == (base[r["doc_id"]] or r["spans"].split(",")[:0]) for r in got)
    assert any("secret:" in r["spans"] for r in got if r["doc_id"] == 503)
    assert pii.detect(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(both).filter("doc_id >= 500 or doc_id = 16").collect()}
    assert clean[16] is None and "[CARD]" in clean[501] and "[SECRET]" in clean[503] and not any(brute_pii(t) for k, t in clean.items() if k in (501, 502, 503))


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 1, "assistant", "no"), (1, 0, "user", "hi"), (2, 0, "system", "s"), (3, 0, "user", "s"), (4, 0, None, None), (4, 0, None, None), (5, 0, None, ""), (5, None, "user", "first"), (6, 0, "user", "alone"), (8, 0, "user", "q"), (9, 0, "user", "q"), (9, 1, "assistant", "a"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    got = {r["pair_id"]: r for r in chat.preferences(turns, chat.pair_neighbours(turns)).collect()}
    assert set(got) == {0, 1, 2, 4}
    one = got[0]
    assert (one["n_prompt"], one["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n"
    a, b = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][a:b] == "yes<|end|>\n"
    assert got[1]["n_prompt"] == 0 and got[1]["chosen_mask"] == ""
    assert got[2]["n_prompt"] == 0 and got[2]["rejected"].startswith("<|user|>\nfirst")
    assert got[4]["chosen"] == "" and got[4]["rejected_mask"] == "14:23"
    assert chat.preferences(turns.limit(0), chat.pair_neighbours(turns.limit(0))).count() == 0


def test_chat_ids_and_long_conversations(spark):
    big = 2**60
    turns = [(big + i, 0, "user", f"q{i}") for i in (2, 3, 4, 5)] + [(c, n, "assistant" if n % 2 else "user", f"{c} {n}" if n else "same") for c in (10, 11) for n in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = chat.pair_neighbours(df).collect()
    assert sorted(map(tuple, pairs)) == [(5, 10, 11), (big // 2 + 1, big + 2, big + 3), (big // 2 + 2, big + 4, big + 5)]
    again = spark.createDataFrame([(1, 10, 11), (1, big + 2, big + 3), (1, big + 2, big + 3)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["prompt"] + r["chosen"][:12]: r for r in chat.preferences(df, again).collect()}
    assert len(got) == 2
    long = next(r for r in got.values() if r["n_prompt"])
    spans = [tuple(map(int, x.split(":"))) for x in long["chosen_mask"].split(",")]
    assert [long["chosen"][a:b] for a, b in spans] == [f"10 {n}<|end|>\n" for n in range(1, 3000, 2)]


def test_edited_copies_are_found(spark):
    """Every copy that truly aligns is found, at four rates of edited words, groups of copies among them."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [[word() for _ in range(rng.randint(8, 40))] for _ in range(60)]
    rows, due = [], set()
    for rate in (0.1, 0.2, 0.3, 0.35):
        for i, item in enumerate(items):
            copy = [word() if rng.random() < rate else w for w in item]
            before, after = [word() for _ in range(30)], [word() for _ in range(30)]
            (score, _, _), = decontaminate.align(np.array([hash(w) % 2**63 for w in item], np.uint64), [np.array([hash(w) % 2**63 for w in before + copy + after], np.uint64)])
            for _ in range(30 if i == 0 else 1):
                rows.append((len(rows), " ".join(before + copy + after)))
                if score >= len(item):
                    due.add((len(rows) - 1, i))
    rows += [(10**6 + k, " ".join(word() for _ in range(80))) for k in range(200)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    missed = due - got
    print(len(due), len(missed))
    # A copy without three unedited words in a row has no seed.
    assert len(due) > 150 and len(missed) <= 0.02 * len(due) and not [d for d in got if d[0] >= 10**6]


def test_bounded_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    got = bounded_sample(df, "doc_id", 100, 3)
    want = df.orderBy(F.xxhash64(F.lit(3), F.col("doc_id"))).limit(100)
    assert same(map(tuple, got.collect()), map(tuple, want.collect()))
