"""Toxicity of long texts, the order of PII spans, and decontamination against all pairs and with shared phrases."""

import random
import re

from pyspark.sql import functions as F

from quillspark.llm import decontaminate, pii, toxicity


def test_long_texts_are_learnt_from(spark):
    r = random.Random(4)
    clean = [f"word{i}" for i in range(400)]
    bad = ["grawlix", "frellish", "smegly", "zarkon"]

    def text(toxic):
        words = [r.choice(clean) for _ in range(2300)]
        for _ in range(200 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad)
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert docs.filter("length(text) <= 10000").count() == 0
    train = docs.filter("doc_id % 3 <> 0")
    model = toxicity.fit(train, train.select("doc_id", "toxic"))
    got = {x["doc_id"]: x["score"] >= 0.3 for x in toxicity.score(docs.filter("doc_id % 3 = 0"), model).collect()}
    toxic = [d for d in got if d % 5 == 0]
    assert sum(got[d] for d in toxic) >= 0.9 * len(toxic) and not any(got[d] for d in got if d % 5)


def test_excerpt(spark):
    text = " ".join(f"w{i}" for i in range(9000))
    whole, short, none, one = spark.createDataFrame([(text,), ("a b",), (None,), ("x" * 30_000,)], "text string").select(toxicity.excerpt(F.col("text"), 10_000).alias("t")).toPandas()["t"]
    assert short == "a b" and none is None and set(one) <= {"x", " "} and len(one) <= 10_020
    assert len(whole) <= 10_020 and set(whole.split()) <= set(text.split()) and int(whole.split()[0][1:]) < 5 and int(whole.split()[-1][1:]) > 8900


def test_spans_by_kind_and_start(spark):
    texts = ["call 0171 555 1234 or +44 171 555 1234", "mail bob (at) example dot com, ann@example.org and 10.0.0.1, card 4111 1111 1111 1111, mail eve [at] example [dot] net", ""]
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for row in rows:
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        keys = [(pii.MORE.index(k), int(a), int(b)) for k, a, b in spans]
        assert keys == sorted(keys), row["spans"]
    assert rows[2]["spans"] == "" and len(rows[1]["spans"].split(",")) >= 4


def words(r, n, vocabulary):
    return [r.choice(vocabulary) for _ in range(n)]


def score(item, text):
    """Plain Smith-Waterman: what the best local alignment scores by the item's own score."""
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, max(row)), row
    return best / (2 * len(item))


def test_against_all_pairs(spark):
    """Every pair of a document and an item that aligns at the threshold is found, and no other."""
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [words(r, r.choice([4, 12, 30, 50]), vocabulary) for _ in range(25)]
    items += [items[3], ["one", "of"], ["one", "of", "the", "most"]]
    docs = []
    for i in range(120):
        text = words(r, r.choice([0, 20, 120]), vocabulary) + ["one", "of", "the", "best"]
        if i % 3 == 0:
            copy = [w if r.random() > r.choice([0, 0.1, 0.25]) else r.choice(vocabulary) for w in r.choice(items)]
            at = r.randint(0, len(text))
            text = text[:at] + copy + text[at:]
        docs.append(text)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)] + [(500, None)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(table, bench).collect()}
    want = {}
    for i, t in enumerate(docs):
        for k, w in enumerate(items):
            s = score(w, t) if len(w) > 2 else 1.0 if re.search(rf"(^|\s){' '.join(w)}(\s|$)", " ".join(t)) else 0.0
            if s >= 0.5:
                want[i, k] = s
    # A pair that shares no three words in a row has no seed: those are the only ones that may be missed, and they are few.
    missed = want.keys() - got.keys()
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    assert not got.keys() - want.keys() and all(not grams(items[k]) & grams(docs[i]) for i, k in missed if len(items[k]) > 4) and len(missed) <= 0.05 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_shared_phrase_makes_no_windows(spark, monkeypatch):
    """600 documents and 600 items that share one phrase: no alignments but of true copies."""
    r = random.Random(3)
    items = [[f"i{k}_{j}" for j in range(10)] + ["one", "of", "the"] + [f"i{k}_{j}" for j in range(10, 20)] for k in range(600)]
    docs = [[f"d{i}_{j}" for j in range(15)] + ["one", "of", "the"] + [f"d{i}_{j}" for j in range(15, 30)] for i in range(600)]
    for i in range(0, 600, 50):
        docs[i] += items[i]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(table, bench).collect()}
    assert got == {(i, i) for i in range(0, 600, 50)}
    seeds = decontaminate.Seeds([decontaminate.WordHashes().array([w.encode() for w in x]) for x in items])
    common = [k for k in range(len(seeds.hashes)) if seeds.first[k + 1] - seeds.first[k] == 600]
    seeds.choose(decontaminate.np.array(common), 0.5)
    hashes = decontaminate.WordHashes()
    made = sum(1 for t in docs for _ in seeds.windows(hashes.array([w.encode() for w in t])))
    assert len(common) == 1 and made == 12 and r


def test_frequent_keys_stay_in_place(spark):
    """Keys of many rows and of few are joined alike."""
    from quillspark.llm.common import join_copies

    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)], "n long, k long")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    want = sorted(map(tuple, rows.join(facts, "k").select("n", "k", "copies").collect()))
    for least in (5, 1000):
        assert sorted(map(tuple, join_copies(rows, facts, "k", least=least).select("n", "k", "copies").collect())) == want
    assert join_copies(rows.limit(0), facts.limit(0), "k").count() == 0
