"""Trims, blanks and chains of lines: against Python's own, and time in proportion to the text."""

import random
import re
import time

from test_text import SPACES, one

from quillspark.functions import text as X


def test_trims_and_blanks_of_random_texts(spark):
    rng = random.Random(9)
    signs = [*SPACES, *" \t \t", "a", "-", "​", "﻿", "é", "\U0001f600"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(400)] + ["  - x", "  -  \ty ", " \t- z", "\t", " "]
    assert one(spark, X.strip, texts) == [t.strip() for t in texts]
    assert one(spark, X.lstrip, texts) == [t.lstrip() for t in texts]
    assert one(spark, X.rstrip, texts) == [t.rstrip() for t in texts]
    tidy = lambda line: ("  " if line.startswith("  - ") else "") + re.sub("[ \t]+", " ", line).strip()
    assert one(spark, X.normalize_whitespace, texts) == ["\n".join(map(tidy, t.split("\n"))) for t in texts]


def test_a_long_run_of_blanks_inside(spark):
    """Its end was sought from each of its 400,000 blanks."""
    text = "a" + " " * 400_000 + "b"
    start = time.time()
    assert one(spark, X.strip, [text, f" {text}\n"]) == [text, text]
    assert one(spark, X.unwrap_lines, [f"- x\n{text}"]) == [f"- x {text}"]
    assert one(spark, X.clean_text, [text]) == ["a b"]
    assert time.time() - start < 60


def test_lines_that_hang_on_one_far_before(spark):
    """A line after an indented bar is joined if the bar was; of items that are lone dashes every second one is joined."""
    n = 3 * X.BLOCK + 5
    bars, dashes = "\n | b" * n, "\n- " * n
    assert one(spark, X.unwrap_lines, [f"x{bars}", f"y:{bars}", f"z:{dashes}"]) == ["x" + " | b" * n, f"y:{bars}", "z:" + "".join(" - " if i % 2 else "\n- " for i in range(n))]
