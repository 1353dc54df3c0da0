"""Running values, as-of joins, interval joins and sweeps against plain loops; on keys that hold nearly all rows."""

import random
import time
from bisect import bisect_right

from pyspark.sql import functions as F

from quillspark.operators import corpus, outline, ranges, retrieval


def test_running(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), i, r.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, x int").repartition(7)
    got = ranges.running(df, ["k"], [F.col("at").asc()], sums={"s": F.col("x")}, tops={"m": F.when(F.col("x") > 3, F.struct("x", "at"))}).collect()
    want, sums, tops = {}, {}, {}
    for k, at, x in rows:
        want[at] = (sums.get(k, 0), tops.get(k))
        sums[k] = sums.get(k, 0) + x
        if x > 3:
            tops[k] = max(tops.get(k, (0, 0)), (x, at))
    assert {g["at"]: (g["s"], tuple(g["m"]) if g["m"] else None) for g in got} == want
    assert ranges.running(df.limit(0), ["k"], [F.col("at").asc()], sums={"s": F.col("x")}).count() == 0


def test_one_key_is_spread_over_blocks(spark):
    """A million rows of one key: ranks and totals, no task with more than a few blocks' rows."""
    start = time.time()
    df = spark.range(1_000_000).select(F.lit("d").alias("k"), "id")
    got = ranges.running(df, ["k"], [F.col("id").asc()], sums={"s": F.lit(1)}, inclusive=True)
    assert got.filter("s <> id + 1").count() == 0
    tied = retrieval.ranked(df.withColumn("score", F.lit(0.5)), "score", True, "id", "rank")
    assert tied.filter("rank <> id + 1").count() == 0
    assert time.time() - start < 120
    placed = spark.range(200_000).select("id").repartitionByRange(4, "id").withColumn("b", F.spark_partition_id()).groupBy("b").count()
    assert placed.count() > 1


def test_as_of(spark):
    r = random.Random(2)
    marks = [(r.choice("ab"), r.randint(0, 500), i) for i in range(60)] + [("c", None, 5)]
    rows = [(r.choice("abc"), r.randint(-5, 520), i) for i in range(400)] + [("a", None, 999)]
    m, x = spark.createDataFrame(marks, "k string, at int, name int"), spark.createDataFrame(rows, "k string, at int, n int")
    for later in (False, True):
        got = {g["n"]: g["name"] for g in ranges.as_of(x, m, ["k"], "at", ["name"], later).collect()}
        for k, at, n in rows:
            near = [(p if later else -p, -name) for q, p, name in marks if q == k and p is not None and at is not None and (p >= at if later else p <= at)]
            assert got[n] == (-min(near)[1] if near else None), (k, at, later)


def test_overlap_join(spark):
    r = random.Random(3)
    one = [("hot" if r.random() < 0.9 else "b", a, a + r.choice([0, 1, 5, 60]), i) for i, a in enumerate(r.randint(0, 300) for _ in range(200))]
    two = [("hot", a, a + r.choice([0, 2, 9, 400]), i) for i, a in enumerate(r.randint(0, 300) for _ in range(150))] + [(None, 0, 5, 900), ("b", None, 5, 901)]
    schema = "doc string, start int, end int, n int"
    got = ranges.overlap_join(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["doc"], size=16).select("n", "r_n").collect()
    want = {(i, j) for k, a, b, i in one for q, c, d, j in two if k == q and c is not None and a < d and c < b}
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_touched_pages(spark):
    """The same as the lookup within a document's row: empty pages, gaps, spans beyond the end."""
    pages = [("d", i + 1, t, ("content",)) for i, t in enumerate(["", "abc", "", "x" * 40, "de", ""])]
    df = spark.createDataFrame(pages, "doc string, page int, text string, metadata struct<page_type:string>")
    placed = corpus.placed_pages(df)
    doc = corpus.stitch(df)
    assert sorted((p["page"], p["start"], p["end"]) for p in placed.collect()) == [(p["page"], p["start"], p["end"]) for p in doc.first()["pages"]]
    spans = [("d", n, a, b) for n, (a, b) in enumerate([(0, 2), (3, 4), (3, 5), (4, 5), (0, 60), (50, 70), (99, 100), (7, 7)])]
    table = spark.createDataFrame(spans, "doc string, n int, start int, end int")
    want = {x["n"]: x["p"] for x in table.join(doc, "doc").select("n", corpus.pages_for(F.col("pages"), F.col("start"), F.col("end")).alias("p")).collect()}
    got = {x["n"]: x["pages"] for x in ranges.touched_pages(table, placed).collect()}
    assert got == want


def test_many_pages_and_units_of_one_document(spark):
    """100,000 pages and units of one document in a minute; as many offsets under as many headings."""
    n, start = 100_000, time.time()
    pages = spark.range(n).select(F.lit("d").alias("doc"), (F.col("id") + 1).cast("int").alias("page"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    spans = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("n"), (F.col("id") * 10 + 4).alias("start"), (F.col("id") * 10 + 13).alias("end"))
    got = ranges.touched_pages(spans, pages).cache()
    assert got.count() == n and got.filter((F.size("pages") != 2) & (F.col("n") < n - 1)).count() == 0
    assert time.time() - start < 60
    marks = pages.filter("page % 10 = 1").select("doc", "start", F.col("page").alias("name"))
    offsets = spark.range(1_000_000).select(F.lit("d").alias("doc"), F.col("id").alias("start"))
    found = ranges.as_of(offsets, marks, ["doc"], "start", ["name"])
    assert found.filter("name <> floor(start / 100) * 10 + 1").count() == 0 and found.count() == 1_000_000


def test_overlap_counts(spark):
    r = random.Random(5)
    span = lambda: (a := r.randint(0, 100), a + r.randint(1, 30))
    spans = [(r.choice("aab"), r.choice(["x", "y"]), *span()) for _ in range(300)]
    asked = [(r.choice("aabc"), i, *span()) for i in range(40)]
    got = ranges.overlap_counts(spark.createDataFrame(spans, "doc string, kind string, start int, end int"), spark.createDataFrame(asked, "doc string, id int, start int, end int"), ["doc"], "kind").collect()
    want = {}
    for d, i, lo, hi in asked:
        for kind in "xy":
            own = [(a, b) for e, k, a, b in spans if e == d and k == kind and a < hi and lo < b]
            if own:
                want[d, i, kind] = (len(own), sum(a < lo for a, _ in own), sum(b > hi for _, b in own))
    assert {(g["doc"], g["id"], g["kind"]): (g["n"], g["starts_before"], g["runs_past"]) for g in got} == want


def test_lines_of_pages(spark):
    r = random.Random(6)
    texts = {d: ["".join(r.choice("ab\n") for _ in range(r.choice([0, 0, 1, 5, 30]))) for _ in range(12)] for d in ("d", "e")} | {"f": ["", ""]}
    rows = [(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    got = sorted((x["doc"], x["start"], x["end"], x["text"]) for x in corpus.placed_lines(corpus.placed_pages(pages)).collect())
    want = corpus.stitch(pages).select("doc", F.explode(corpus.lines_of(F.col("text"))).alias("l")).select("doc", "l.start", "l.end", "l.text").collect()
    assert got == sorted(map(tuple, want))


def test_headings_at(spark):
    body = ["Working Days\n\ntext here.\nPart 1: Hours:\nmore\n\nExtra Days\n\nplain words.", "Part 2 x\nlower", "Last One"]
    pages = spark.createDataFrame([("D", i + 2, t, ("content",)) for i, t in enumerate(body)] + [("D", 1, "Cover Words", ("cover",)), ("E", 1, "no heading here.", ("content",))], "doc string, page int, text string, metadata struct<page_type:string>")
    stitched = corpus.stitch(pages)
    doc = stitched.filter("doc = 'D'").first()
    heads = stitched.filter("doc = 'D'").select(outline.sections(F.col("doc"), F.col("text"), F.col("content_start")).alias("s")).first()["s"]
    assert [h["breadcrumb"] for h in heads] == ["D > Working Days", "D > Working Days > Part 1: Hours", "D > Extra Days", "D > Extra Days > Part 2 x", "D > Last One"]
    assert [h["end_full"] for h in heads] == [heads[2]["start"], heads[2]["start"], heads[4]["start"], heads[4]["start"], len(doc["text"])]
    offsets = spark.createDataFrame([("D", i) for i in range(len(doc["text"]))] + [("E", 3)], "doc string, start long")
    starts = [h["start"] for h in heads]
    for x in outline.headings_at(offsets, corpus.placed_pages(pages)).collect():
        if x["doc"] == "E":
            assert x["section"] == "E"
            continue
        i = bisect_right(starts, x["start"]) - 1
        assert x["section"] == ("D > Document Information" if x["start"] < doc["content_start"] else heads[i]["breadcrumb"] if i >= 0 else "D")


def test_medians(spark):
    r = random.Random(8)
    own = {"a": [r.randint(0, 9) for _ in range(501)], "b": [r.randint(-(10**12), 10**12) for _ in range(400)], "c": [7] * 9, "d": [1, 2], "e": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in own.items() for v in vs], "k string, v long").repartition(3)
    got = dict(ranges.medians(df, ["k"], "v").collect())
    middle = lambda vs: (sorted(vs)[(len(vs) - 1) // 2] + sorted(vs)[len(vs) // 2]) / 2
    assert got == {k: middle(vs) if vs != [None] else None for k, vs in own.items()}
    assert ranges.medians(df.filter("k = 'a'"), [], "v").first()[0] == middle(own["a"])
