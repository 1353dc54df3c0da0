"""Array functions as Column expressions whose time is in proportion to the array (or nearly so).

aggregate() copies its whole state at each step, so a fold that gathers an array or a text takes quadratic time. Here
states are single numbers only, and running values are found in two levels of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once for each row, however often f names it, inside lambda functions too."""
    return F.transform(F.array(x), f)[0]


def upto(n: Column) -> Column:
    """0 to n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running(values: Column, start: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each element, what an associative `op` makes of `start` and all elements before it. start is neutral."""
    fold = lambda a: F.aggregate(a, start, op)

    def inside(v: Column) -> Column:
        n = F.ceil(F.size(v) / BLOCK).cast("int")
        block = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        spread = lambda head, m: F.transform(upto(F.size(m)), lambda i: op(head, fold(F.slice(m, F.lit(1), i))))
        return let(
            F.transform(upto(n), lambda b: fold(block(b))),
            lambda sums: F.flatten(F.transform(upto(n), lambda b: let(fold(F.slice(sums, F.lit(1), b)), lambda head: let(block(b), lambda m: spread(head, m))))),
        )

    return let(values, inside)


#: Characters of a block of a text that is cut in many places.
PART = 4096


def parts_of(text: Column) -> Column:
    """The text in blocks of PART characters, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Characters start to end - 1 of a text in blocks. substring() would walk from the text's start each time."""
    first = F.floor(start / PART).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.greatest(F.floor((end - 1) / PART).cast("int") - first + 1, F.lit(0))), "")
    return F.substring(near, start - first * PART + 1, end - start)
