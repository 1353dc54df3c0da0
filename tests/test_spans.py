"""Cutting documents: values from the rules, and invariants on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, corpus, quality, spans


def stitched(spark, rows, template="plain"):
    meta = "struct<title:string,version:string,effective_date:string,page_type:string>"
    df = spark.createDataFrame([(d, p, t, (None, None, None, k)) for d, p, t, k in rows], f"doc string, page int, text string, metadata {meta}")
    return corpus.stitch(df).withColumn("template", F.lit(template))


@pytest.mark.parametrize("n,expected", [(1200, [(0, 500), (450, 950), (900, 1200)]), (950, [(0, 500), (450, 950)]), (501, [(0, 500), (450, 501)]), (500, [(0, 500)]), (0, [])])
def test_windows(spark, n, expected):
    got = spark.createDataFrame([("x" * n,)], "t string").select(chunking.windows(F.col("t"))).first()[0]
    assert [(w["start"], w["end"]) for w in got] == expected


def test_windows_want_a_smaller_overlap():
    with pytest.raises(ValueError):
        chunking.windows(F.lit("x"), 50, 50)


def test_rows_of_a_large_table():
    head = "| name | n |\n| --- | --- |"
    text = head + "\n" + "\n".join(f"| r{i} | {i * 11} |" for i in range(5))
    got = spans.table_units(text, spans.Unit(0, len(text), text, True), 50)
    assert all(u.text.startswith(head) and not u.verbatim for u in got)
    assert sum(u.text.count("\n| r") for u in got) == 5
    assert spans.table_units(head, spans.Unit(0, len(head), head, True), 5) == []


def test_separators_stay_on_the_left():
    text = "a\n\n\n\n\nb"
    assert [text[a:b] for a, b in spans._cut_after(text, 0, len(text), "\n\n")] == ["a\n\n", "\n\n", "\nb"]


def test_recursive_split_keeps_everything():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "bb", " ", ". ", "\n", "\n\n", "ccc"], k=rng.randint(0, 80)))
        size = rng.randint(3, 40)
        got = spans.recursive_split(text, 0, len(text), size)
        assert "".join(u.text for u in got) == text
        assert all(0 < len(u.text) <= size for u in got)


def test_stitch_and_pages(spark):
    doc = stitched(spark, [("d", 4, "c", "content"), ("d", 1, "", "cover"), ("d", 2, "ab", "content"), ("d", 3, None, "content")]).first()
    assert doc["text"] == "ab\n\n\n\nc"
    assert [p["start"] for p in doc["pages"]] == [0, 0, 4, 6]
    rows = stitched(spark, [("d", 1, "abc", "content"), ("d", 2, "def", "content")])
    got = rows.select(*(corpus.pages_for(F.col("pages"), F.lit(a), F.lit(b)) for a, b in ((0, 2), (2, 6), (3, 4), (9, 9)))).first()
    assert [list(x) for x in got] == [[1], [1, 2], [2], [2]]


def heads(lines):
    return [s.breadcrumb for s in spans.outline("D", "\n".join(lines), 0)]


def test_numbered_outline():
    assert heads(["2. No", "1.0 SCOPE:", "a. First", "c. No", "b. Second", "2. Next", "2.1 Sub", "2.3 No", "2.2. Other", "3.2 No", "3. End"]) == [
        "D > 1.0 SCOPE", "D > 1.0 SCOPE > a. First", "D > 1.0 SCOPE > b. Second", "D > 2. Next", "D > 2. Next > 2.1 Sub", "D > 2. Next > 2.2 Other", "D > 3. End",
    ]


def test_plain_outline(spark):
    lines = ["Working Days", "", "text here.", "Part 1: Hours:", "more", "", "Extra Days", "", "Part 2 x", "lower case", "", "Ends with dot.", ""]
    found = chunking.with_outline(stitched(spark, [("D", 1, "\n".join(lines), "content")]).withColumn("template", F.lit("plain"))).first()["sections"]
    got = [s["breadcrumb"] for s in found]
    assert got == ["D > Working Days", "D > Working Days > Part 1: Hours", "D > Extra Days", "D > Extra Days > Part 2 x"]


def test_sections_and_their_records(spark):
    body = "1. One\n" + "word " * 20 + "\n2. Two\nshort\na. Leaf\n" + "long text. " * 30
    docs = stitched(spark, [("My Doc", 1, "Cover words", "cover"), ("My Doc", 2, body, "content")], "sop")
    rows = chunking.chunk(docs, "section", section_most=200).orderBy("chunk_id").collect()
    assert rows[0]["section"] == "My Doc > Document Information" and rows[0]["page_start"] == 1
    assert rows[1]["section"] == "My Doc > 1. One" and rows[1]["chunk_id"] == "section-my-doc-002"
    # The short text of section 2 goes with its first child.
    assert rows[2]["section"] == "My Doc > 2. Two > a. Leaf" and rows[2]["text"].startswith("2. Two")
    assert all(len(r["text"]) <= 200 for r in rows)
    assert quality.check(chunking.chunk(docs, "section")).filter("severity = 'error'").count() == 0


def test_fixed_by_columns_and_by_units(spark):
    text = "One line of text. " * 80
    docs = stitched(spark, [("d", 1, text, "content")])
    a = chunking.chunk(docs, "fixed").select("metadata.char_start", "metadata.char_end", "text").collect()
    b = docs.select(F.explode(chunking.windows(F.col("text"))).alias("w")).select("w.*").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_context_and_tables(spark):
    df = spark.createDataFrame([("D", "Long", "D > 1. X"), ("D", "d", "D > 1. X"), ("D", None, "D > 1. X")], "d string, t string, s string")
    assert [r[0] for r in df.select(chunking.context_line(F.col("d"), F.col("t"), F.col("s"))).collect()] == ["D (Long) > 1. X", "D > 1. X", "D > 1. X"]
    text = "x\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n| c |\nend"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.table_info(F.col("t"), F.lit(False))).first()[0]
    assert [(t["columns"], t["rows"]) for t in got] == [(["a", "b"], 1), (["c"], 0)]


def test_long_texts_take_linear_time(spark):
    """One text of 10 MB: 20,000 lines and more, windows, regions, clean text and pages."""
    import time

    from quillspark.functions import text as X

    line = "word " * 50
    text = "\n".join(f"| {i} | {line} |" if i % 5 == 0 else f"{line}{i}." for i in range(40_000))
    assert len(text) > 10_000_000
    df = spark.createDataFrame([("d", 1, text), ("d", 2, None), ("e", 1, "")], "doc string, page int, text string")
    took = {}
    for name, rows in {
        "regions": lambda: corpus.regions(df.filter("doc = 'd' and page = 1")).count(),
        "windows": lambda: df.select(F.explode(chunking.windows(F.col("text"))).alias("w")).filter("length(w.text) > 0").count(),
        "unwrap": lambda: df.select(F.length(X.unwrap_lines(F.col("text"))).alias("n")).filter("n > 1000000").count(),
        "pages": lambda: corpus.stitch(df).filter("size(pages) > 0").count(),
    }.items():
        start = time.time()
        assert rows() == {"regions": 16_000, "windows": -(-(len(text) - 500) // 450) + 1, "unwrap": 1, "pages": 2}[name], name
        took[name] = time.time() - start
    assert max(took.values()) < 20, took


def test_many_pages(spark):
    rows = [("d", i, "x" * (i % 7), "content") for i in range(5000)]
    doc = stitched(spark, rows).first()
    at, text = [], ""
    for _, _, t, _ in rows:
        text += "\n\n" if text else ""
        at.append((len(text), len(text) + len(t)))
        text += t
    assert doc["text"] == text and [(p["start"], p["end"]) for p in doc["pages"]] == at


def test_dropped_tables_are_noted(spark):
    wide = "| " + "a" * 1200 + " |\n| --- |"
    docs = stitched(spark, [("d", 1, f"text\n{wide}\nmore\n| a |\n| - |\n| 1 |", "content")])
    assert [tuple(r) for r in quality.dropped_tables(docs).collect()] == [("d:5", "table_dropped", "note")]
    assert all("aaa" not in r["text"] for r in chunking.chunk(docs, "section").collect())
