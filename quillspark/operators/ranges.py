"""Joins by ranges and running values over ordered rows, for keys of any size: no key's rows are brought into one task.

Running values take ordered blocks: rows are dealt by ranges of (key, order), each block is summed, the sums of a key's blocks are added up in
order (one row for each block), and each row adds what its block makes of the rows before it. The blocks are written once, as
the bounds of ranges are drawn anew at each evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut

#: Positions in a bin of an interval join.
BIN = 4096


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, inclusive: bool = False) -> DataFrame:
    """df with running values among the rows of the same keys that come earlier in `order`, the row itself included if `inclusive`.

    sums: totals of whole numbers, 0 at first; tops: the largest so far, null at first. Rows that tie in `order` come in
    either order, so it should name rows. Null keys are a key.
    """
    sums, tops = sums or {}, tops or {}
    names = [f"_run{i}" for i in range(len(sums) + len(tops))]
    whole = {**sums, **tops}
    rows = df.withColumns(dict(zip(names, whole.values(), strict=True))) if whole else df
    placed = cut(rows.repartitionByRange(*(F.col(f"`{k}`").asc_nulls_first() for k in keys), *order).withColumn("_run_block", F.spark_partition_id()))
    fold = [F.sum] * len(sums) + [F.max] * len(tops)
    # One row for each key and block; those of the first block of a key carry nothing. The others are fewer than blocks.
    key = [F.col(f"`{k}`") for k in keys]
    totals = placed.groupBy(*key, "_run_block").agg(*(f(n).alias(n) for f, n in zip(fold, names, strict=True)))
    before = Window.partitionBy(*key).orderBy("_run_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(c.alias(f"_run_key{i}") for i, c in enumerate(key)), F.col("_run_block").alias("_run_at"), *(f(n).over(before).alias(f"{n}_c") for f, n in zip(fold, names, strict=True)), (F.row_number().over(Window.partitionBy(*key).orderBy("_run_block")) > 1).alias("_run_later")).filter("_run_later").drop("_run_later")
    same = F.col("_run_block") == F.col("_run_at")
    for i, c in enumerate(key):
        same = same & c.eqNullSafe(F.col(f"_run_key{i}"))
    joined = placed.join(F.broadcast(carried), same, "left")
    local = Window.partitionBy(*key, "_run_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def value(f, n: str) -> Column:
        own = f(n).over(local)
        if f is F.sum:
            return F.coalesce(own, F.lit(0)) + F.coalesce(F.col(f"{n}_c"), F.lit(0))
        return F.greatest(own, F.col(f"{n}_c"))

    kept = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, *(value(f, n).alias(name) for name, f, n in zip(whole, fold, names, strict=True)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], later: bool = False) -> DataFrame:
    """left with the columns `take` of the row of right with the same keys that is the last one at or before its `at`
    (later: the first one at or after it), null where there is none. Of right's rows at one position the largest counts.

    Both sides become one list by position; the last row of right so far runs through it. left's own names must differ from `take`.
    """
    sign = -1 if later else 1
    marks = right.filter(F.col(at).isNotNull()).select(*keys, (F.col(at) * sign).alias("_p"), F.lit(0).alias("_k"), F.struct((F.col(at) * sign).alias("_p"), *take).alias("_mark"))
    rows = left.select(*keys, (F.col(at) * sign).alias("_p"), F.lit(1).alias("_k"), F.struct(*left.columns).alias("_row"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    found = running(both, keys, [F.col("_p").asc_nulls_first(), F.col("_k").asc()], tops={"_last": F.col("_mark")}, inclusive=True)
    # A null position is before all others and has no mark.
    hit = lambda c: F.when(F.col("_p").isNotNull(), F.col(f"_last.{c}")).alias(c)
    return found.filter("_k = 1").select("_row.*", *(hit(c) for c in take), "_p").drop("_p")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], size: int = BIN) -> DataFrame:
    """Pairs of rows of the same keys whose intervals [start, end) share a position: left's columns, and right's with the prefix r_.

    Both sides are cut into bins and joined by key and bin; a pair is kept in the first bin that both are in. An empty interval lies
    between two positions and overlaps those that hold both; null bounds share nothing.
    """
    fits = F.col("start") <= F.col("end")
    bins = lambda a, b: F.sequence(F.floor(a / size), F.floor(F.greatest(b - 1, a) / size))
    one = left.filter(fits).withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"))))
    two = right.filter(fits).select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.explode(bins(F.col("start"), F.col("end"))).alias("r__bin"))
    same = (F.col("_bin") == F.col("r__bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    first = F.col("_bin") == F.floor(F.greatest("start", "r_start") / size)
    return one.join(two, same & first).drop("_bin", "r__bin")


def touched_pages(spans: DataFrame, pages: DataFrame, id: str = "n") -> DataFrame:
    """(doc, id, pages): for each span (doc, id, start, end) the numbers of the pages (doc, page, start, end) that it touches, in
    their order; failing that the first page from its start on, else the last. The pairs (doc, id) name spans.

    The same as corpus.pages_for, with spans and pages as tables.
    """
    own = cut(spans.select("doc", id, "start", "end"))
    hits = overlap_join(own, pages.select("doc", "page", "start", "end"), ["doc"]).select("doc", id, "r_start", "r_page")
    # A page that is empty or a span in a gap touches nothing: another way for the rest.
    found = hits.groupBy("doc", id).agg(F.array_sort(F.collect_list(F.struct("r_start", "r_page"))).alias("p")).select("doc", id, F.transform("p", lambda p: p["r_page"]).alias("pages"))
    rest = own.join(found, ["doc", id], "left_anti")
    later = as_of(rest.select("doc", id, "start"), pages.select("doc", "start", (-F.col("page")).alias("_page")), ["doc"], "start", ["_page"], later=True)
    last = pages.groupBy("doc").agg(F.max_by("page", F.struct("start", "page")).alias("_end"))
    others = later.join(last, "doc").select("doc", id, F.array(F.coalesce(-F.col("_page"), "_end")).alias("pages"))
    return found.unionByName(others)


def overlap_counts(spans: DataFrame, ranges: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each range (keys, id, start, end) and each value of `by` among the spans (keys, by, start, end) of its keys: how many of them overlap it,
    how many of these start before it, and how many run past its end: n, starts_before, runs_past. Neither is empty.

    A sweep over sorted ends and starts: the numbers of starts and of ends up to a range's two ends tell all three; no pair is made.
    """
    kinds = spans.select(*keys, by).distinct()
    asked = ranges.select(*keys, "id", "start", "end").join(kinds, keys)
    point = lambda df, c, k, *more: df.select(*keys, by, F.col(c).alias("_at"), F.lit(k).alias("_k"), *more)
    # At one position: what ends there, then a range's bound, then what starts there.
    events = point(spans, "end", 0).unionByName(point(spans, "start", 2)).unionByName(point(asked, "start", 1, "id", F.lit(True).alias("_low")).unionByName(point(asked, "end", 1, "id", F.lit(False).alias("_low"))), allowMissingColumns=True)
    flag = lambda k: F.when(F.col("_k") == k, 1).otherwise(0)
    seen = running(events, [*keys, by], [F.col("_at").asc(), F.col("_k").asc()], sums={"_ended": flag(0), "_begun": flag(2)}).filter("_k = 1")
    at = lambda low, c: F.max(F.when(F.col("_low") == low, F.col(c)))
    found = seen.groupBy(*keys, by, "id").agg(at(True, "_begun").alias("a"), at(True, "_ended").alias("b"), at(False, "_begun").alias("c"), at(False, "_ended").alias("d"))
    return found.select(*keys, "id", by, (F.col("c") - F.col("b")).alias("n"), (F.col("a") - F.col("b")).alias("starts_before"), (F.col("c") - F.col("d")).alias("runs_past")).filter("n > 0")


#: Bins of a histogram that looks for a rank.
BINS = 1024


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the exact median of whole numbers for each key, null for keys without values.

    Both middle ranks are looked for in a histogram of BINS bins over the values' range, then in one of the bin that holds the
    rank, until bins are single numbers: no task or group holds more than BINS rows for each key and rank, whatever the values are.
    """
    rows = df.select(*keys, F.col(value).cast("long").alias("_v")).filter("_v is not null")
    facts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.explode(F.array(F.call_function("div", F.col("_n") - 1, F.lit(2)), F.call_function("div", F.col("_n"), F.lit(2))))
    wide = lambda n: F.call_function("div", n + (BINS - 1), F.lit(BINS))
    state = cut(facts.withColumn("_width", wide(F.col("_high") - F.col("_low") + 1)).select(*keys, "_low", "_width", ranks.alias("_left")).withColumn("_r", F.monotonically_increasing_id()))
    most = state.agg(F.max("_width")).first()[0]
    while most:
        bin_ = F.call_function("div", F.col("_v") - F.col("_low"), F.col("_width"))
        same = [F.col(f"_s.{k}").eqNullSafe(F.col(f"_d.{k}")) for k in keys]
        inside = (F.col("_v") >= F.col("_low")) & (F.col("_v") < F.col("_low") + F.col("_width") * BINS)
        met = rows.alias("_d").join(state.alias("_s"), [*same, inside] if keys else inside)
        counts = met.groupBy("_r", bin_.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy("_r").orderBy("_b")
        held = counts.withColumn("_to", F.sum("_c").over(w)).join(state, "_r").filter((F.col("_left") < F.col("_to")) & (F.col("_left") >= F.col("_to") - F.col("_c")))
        low, left = F.col("_low") + F.col("_b") * F.col("_width"), F.col("_left") - (F.col("_to") - F.col("_c"))
        # A bin of one number is found; its width stays one and its place is its own first bin.
        state = cut(held.select(*keys, low.alias("_low"), wide(F.col("_width")).alias("_width"), left.alias("_left"), "_r"))
        most = most // BINS + (most % BINS > 0) if most > 1 else 0
    found = state.groupBy(*keys).agg(F.avg("_low").alias("median"))
    return df.select(*keys).distinct().join(found, keys, "left") if keys else found
