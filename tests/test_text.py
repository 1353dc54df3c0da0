"""Cleaning and string functions: values from the rules, and random texts against plain loops written from them."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.corpus import lines_of

SPACES = [chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
CASES = [
    ("●​Foo\nbar", "- Foo bar"),
    ("●\nFoo", "- Foo"),
    ("o​CPU\nother", "- CPU other"),
    ("1.​Purpose\nThe text", "1. Purpose The text"),
    ("Note:\nfirst line\nsecond line", "Note:\nfirst line second line"),
    ("| a | b |\nplain", "| a | b |\nplain"),
    ("a\n\n\n\nb  \t c", "a\n\nb c"),
    ("“x”–y z", '"x"-y z'),
    ("line one\n1-You are\n0-4 hours", "line one\n1-You are 0-4 hours"),
    ("-\nword", "- word"),
    ("Half Day: x\ny", "Half Day: x y"),
    ("soft­hyphen", "softhyphen"),
    ("foo\n  -", "foo -"),
    ("", ""),
    (None, None),
]


def one(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def test_clean_text(spark):
    assert one(spark, X.clean_text, [a for a, _ in CASES]) == [b for _, b in CASES]


def test_strip_knows_every_space(spark):
    assert len(SPACES) == 29
    values = [f"{s}a{s}b{s}" for s in SPACES] + ["​a​"]
    assert one(spark, X.strip, values) == [v.strip() for v in values]
    assert one(spark, X.squash, [f"{s}a{s}{s}b" for s in SPACES]) == ["a b"] * 29


def test_unwrap_against_a_loop(spark):
    rng = random.Random(4)
    pieces = ["", " ", "-", "- x", "word", "ends:", "| cell |", "1. Head", "2-You", "0-4", "a. item", "Part 3. In", "Label: v", "  lead"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(300)]
    starts = ("- ", "| ", "1. ", "2-Y", "a. ", "Part 3.", "Label:")

    def expected(t):
        out, last, joined = "", None, False
        for line in t.split("\n"):
            item = line.lstrip().startswith("- ") or line.startswith(starts[1:])
            glue = last is not None and last.strip() and line.strip() and ((last.strip() == "-" and not joined) or not item) and not last.endswith(":") and not (last.lstrip().startswith("|") and not joined)
            out += (" " + line.lstrip()) if glue else ("\n" if last is not None else "") + line
            last, joined = line, bool(glue)
        return out

    assert one(spark, X.unwrap_lines, texts) == [expected(t) for t in texts]


@pytest.mark.parametrize(
    "function,value,expected",
    [
        (X.slug, "Night Shift & Night Allowance", "night-shift-night-allowance"),
        (X.snake, " Issued To ", "issued_to"),
        (X.title_case, "process owner's NAME", "Process Owner'S Name"),
        (X.short_id, "section-night-shift-003", "shift-003"),
        (X.doc_label, "a.pdf", "a"),
        (X.doc_label, None, "unknown"),
    ],
)
def test_names(spark, function, value, expected):
    assert one(spark, function, [value]) == [expected]


def test_many_lines(spark):
    """Folds over lines work in blocks; texts about and beyond the size of a block come out whole."""
    texts = ["\n".join(f"- item {i}" if i % 3 else "some words" for i in range(n)) for n in (1, X.BLOCK - 1, X.BLOCK, X.BLOCK + 1, 2 * X.BLOCK, 2000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", X.unwrap_lines(F.col("t")).alias("u"), lines_of(F.col("t")).alias("l")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["u"] == t.replace("\nsome words", " some words")
        assert [x["text"] for x in r["l"]] == t.split("\n")
        assert all(t[x["start"] : x["end"]].rstrip("\n") == x["text"] for x in r["l"])
