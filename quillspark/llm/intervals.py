"""Interval overlap join of two sides by client: for each left interval and each of Allen's relations, totals of the right
intervals that share a slot with it. No pair is ever a row.

Slots are whole numbers and intervals hold both ends; an end that is null is open, that is infinite. Equal intervals of a
client are one row before any shuffle of the join, so what a very frequent client costs grows with its slots, not its rows.

A shard is a client and a run of WINDOW slots. It holds the intervals that start there and those with an end that reach into it;
each pair is met in the shard where its later interval starts. One task takes a shard's endpoint events in order, starts
before ends at equal slots, and keeps two hash tables by end of what is active: right intervals with their sums, left
ones with running sums of what has started since. Rights without an end that began in an earlier shard, and rights that begin in shards after
that of a left one without an end, meet it by sums of each shard, from the same table that tells where copies have to go.

Defined results: rows with a null client or start take no part; an end before its start counts as the start (a session or
a sale has none); a repeated row is an interval of its own; an empty side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

#: Slots of a shard.
WINDOW = 28
SLOT = 6 * 3_600_000_000
GAP = 15 * 60_000_000
#: By where the left interval starts (before the right one, with it, after it), then by where it ends.
RELATIONS = (("contains", "finished_by", "overlaps"), ("started_by", "equals", "starts"), ("overlapped_by", "finishes", "during"))
_NAMES = [name for row in RELATIONS for name in row]
_OUT = pa.schema([("client", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("relation", pa.string()), ("n", pa.int64()), ("slots", pa.int64()), ("crc", pa.int64())])
_OUT_DDL = "client long, a long, b long, relation string, n long, slots long, crc long"
_EVER = 1 << 62
#: Kinds of a shard's rows: intervals of both sides; open rights of earlier shards; rights of later ones, with an end and without.
_LEFT, _RIGHT, _BEFORE, _AFTER, _AFTER_OPEN = range(5)


def micros(ts: Column, kind: str) -> Column:
    """Whole microseconds since 1970 of a timestamp, whatever the session's time zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    since = ts - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda name, size: F.extract(F.lit(name), since).cast("long") * size
    return part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def floored(x: Column, size: int) -> Column:
    """x divided by size, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(size)), F.lit(size))


def sessions(clicks: DataFrame, gap: int = GAP, day: int = 96) -> DataFrame:
    """(client, first, last, open) of each run of a client's clicks (client, at, error) that are at most `gap` apart.

    Clicks of one cell of `gap` microseconds always belong together, so cells are summed first, before they are shuffled. Runs
    are then found in days of `day` cells; only those at a day's edge meet those of other days, two a day at most.
    """
    # A timestamp and whether it is an error's as one whole number: the largest is the last one, an error before others at it.
    mark = F.col("at") * 2 + F.coalesce("error", F.lit(False)).cast("long")
    cells = clicks.filter("client is not null and at is not null").groupBy("client", floored(F.col("at"), gap).alias("cell"))
    cells = cells.agg(F.min("at").alias("first"), F.max(mark).alias("mark"))
    last = F.shiftright("mark", 1)

    def runs(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("first")
        rows = rows.withColumn("new", F.coalesce(F.col("first") - F.lag(last).over(w) > gap, F.lit(True)))
        rows = rows.withColumn("run", F.sum(F.col("new").cast("long")).over(w))
        return rows.groupBy(*by, "run").agg(F.min("first").alias("first"), F.max("mark").alias("mark"))

    found = runs(cells.withColumn("day", floored(F.col("cell"), day)), "client", "day")
    edge = lambda at, rest: F.pmod(floored(at, gap), F.lit(day)) == rest
    found = found.withColumn("edge", edge(F.col("first"), 0) | edge(last, day - 1))
    whole = found.filter(~F.col("edge")).unionByName(runs(found.filter("edge"), "client"), allowMissingColumns=True)
    return whole.select("client", "first", last.alias("last"), (F.pmod("mark", F.lit(2)) == 1).alias("open"))


def _shards(batches):
    """(client, shard, rows) of each shard that has a row other than a left interval. A shard's rows are different intervals, so
    no more than its slots and ends allow."""
    rest = None
    for batch in batches:
        rows = np.stack([c.fill_null(_EVER).to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        cuts = [0, *(np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1).tolist()]
        rest = rows[:, cuts[-1] :]
        for lo, hi in zip(cuts, cuts[1:]):
            if (rows[4, lo:hi] != _LEFT).any():
                yield int(rows[0, lo]), int(rows[1, lo]), rows[2:, lo:hi].T.tolist()
    if rest is not None and (rest[4] != _LEFT).any():
        yield int(rest[0, 0]), int(rest[1, 0]), rest[2:].T.tolist()


def _add(sums: dict, k: int, n: int, slots: int | None, crc: int) -> None:
    had = sums.get(k)
    sums[k] = (n, slots, crc) if had is None else (had[0] + n, None if slots is None else had[1] + slots, had[2] + crc)


def _pair(sums: dict, since: int, at: int, b: int, e: int, n: int, crc: int) -> None:
    """n rights that end at e meet a left that ends at b; the later of them starts at `at`, which the left does before, with or after them."""
    _add(sums, 3 * since + (0 if b > e else 1 if b == e else 2), n, None if b == e == _EVER else (min(b, e) - at + 1) * n, crc)


def _sweep(first: int, rows: list):
    """(a, b, sums by relation) of each left interval of a shard, from rows (a, b, side, n, slots, crc) by a; `first` is its first slot."""
    lefts: dict[int, dict] = {}  # active, by end: sums of the rights that started since the first left with that end became active
    known: dict[int, list] = {}  # active, by end: (start, sums at its own start, the running sums then)
    rights: dict[int, tuple[int, int]] = {}  # active, by end: rows and crcs

    def close(before: int):
        """Intervals that end before a slot are done."""
        for b in [b for b in known if b < before]:
            running = lefts.pop(b)
            for a, own, then in known.pop(b):
                for k, (n, slots, crc) in running.items():
                    n0, slots0, crc0 = then.get(k, (0, 0, 0))
                    if n > n0:
                        own[k] = (n - n0, None if slots is None else slots - (slots0 or 0), crc - crc0)
                if own:
                    yield a, b, own
        for e in [e for e in rights if e < before]:
            del rights[e]

    def enter(into: dict, e: int, n: int, crc: int) -> None:
        had = into.get(e, (0, 0))
        into[e] = (had[0] + n, had[1] + crc)

    # Active from the shard's start on; such rows come first.
    at = 0
    while at < len(rows) and (rows[at][0] < first):
        a, b, side, n, _, crc = rows[at]
        if side == _LEFT:
            lefts.setdefault(b, {})
            known.setdefault(b, []).append((a, {}, {}))
        else:
            enter(rights, b, n, crc)
        at += 1
    while at < len(rows) and rows[at][2] < _AFTER:
        now, new_left, new_right = rows[at][0], [], {}
        while at < len(rows) and rows[at][0] == now:
            a, b, side, n, _, crc = rows[at]
            if side == _LEFT:
                new_left.append((a, b))
            else:
                enter(new_right, b, n, crc)
            at += 1
        # Starts come before ends at the same slot: what ended earlier is past, what ends here is still active.
        yield from close(now)
        for b, sums in lefts.items() if new_right else ():
            for e, (n, crc) in new_right.items():
                _pair(sums, 0, now, b, e, n, crc)
        for a, b in new_left:
            own: dict = {}
            for e, (n, crc) in new_right.items():
                _pair(own, 1, now, b, e, n, crc)
            for e, (n, crc) in rights.items():
                _pair(own, 2, now, b, e, n, crc)
            known.setdefault(b, []).append((a, own, dict(lefts.setdefault(b, {}))))
        for e, (n, crc) in new_right.items():
            enter(rights, e, n, crc)
    # Sums of the rights of later shards, which every left without an end meets.
    for _, _, side, n, slots, crc in rows[at:]:
        if _EVER in lefts:
            _add(lefts[_EVER], 0 if side == _AFTER else 1, n, slots if side == _AFTER else None, crc)
    yield from close(_EVER + 1)


def _swept(batches):
    """Rows (client, shard, a, b, side, n, slots, crc), sorted by client, shard and a, to totals by left interval."""
    out: list[list] = [[] for _ in _OUT]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)

    for client, shard, rows in _shards(batches):
        for a, b, sums in _sweep(shard * WINDOW, rows):
            for k, (n, slots, crc) in sums.items():
                for column, value in zip(out, (client, a, None if b == _EVER else b, _NAMES[k], n, slots, crc), strict=True):
                    column.append(value)
        if len(out[0]) > 20_000:
            yield batch()
            for c in out:
                c.clear()
    yield batch()


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(client, a, b, relation, n, slots, crc) for each different interval (client, a, b) of `left` and each relation in which
    it shares a slot with intervals of `right` (client, a, b, crc). slots is null where neither ends.
    """
    # greatest() passes over nulls, so it is asked for only where there is an end.
    left, right = (df.filter("client is not null and a is not null").withColumn("b", F.when(F.col("b").isNotNull(), F.greatest("a", "b"))) for df in (left, right))
    shard, ends = floored(F.col("a"), WINDOW), F.col("b").isNotNull()
    theirs = right.groupBy("client", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc")).withColumn("shard", shard)
    # Both sides are read more than once from here on: a written table each, of equal intervals as one row.
    theirs = cut(theirs)
    mine = left.select("client", "a", "b").distinct().join(theirs.select("client").distinct(), "client", "left_semi").withColumn("shard", shard)
    mine = cut(mine)

    # What starts in each shard of a client; from that, what open rights come from before, and what comes after.
    some = lambda c, x, name: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(name)
    sums = theirs.groupBy("client", "shard").agg(some(~ends, F.col("n"), "open_n"), some(~ends, F.col("crc"), "open_crc"), some(ends, F.col("n"), "n"), some(ends, F.col("n") * (F.col("b") - F.col("a") + 1), "slots"), some(ends, F.col("crc"), "crc"))
    names, own = sums.columns[2:], mine.groupBy("client", "shard").agg(F.lit(True).alias("own"))
    both = sums.unionByName(own, allowMissingColumns=True).groupBy("client", "shard").agg(F.max("own").alias("own"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    w = Window.partitionBy("client").orderBy("shard")
    early = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    sides = both.select("client", "shard", "own", early("open_n").alias("before_n"), early("open_crc").alias("before_crc"), *(later(c).alias(c) for c in names)).filter("own")
    row = lambda side, n, slots, crc: F.struct(F.lit(side).cast("long").alias("side"), n.alias("n"), slots.alias("slots"), crc.alias("crc"))
    nothing = F.lit(0).cast("long")
    carried = F.array(row(_BEFORE, F.col("before_n"), nothing, F.col("before_crc")), row(_AFTER, F.col("n"), F.col("slots"), F.col("crc")), row(_AFTER_OPEN, F.col("open_n"), nothing, F.col("open_crc")))
    # The first of these stand before all other rows of a shard, the others after them.
    place = F.when(F.col("c.side") == _BEFORE, F.lit(-_EVER)).otherwise(F.lit(_EVER))
    c_rows = sides.select("client", "shard", F.explode(carried).alias("c")).filter("c.n > 0").select("client", "shard", place.alias("a"), F.lit(None).cast("long").alias("b"), "c.side", "c.n", "c.slots", "c.crc")

    reach = F.when(ends, F.sequence("shard", floored(F.col("b"), WINDOW))).otherwise(F.array("shard"))
    spread = lambda df, side, n, crc: df.select("client", F.explode(reach).alias("shard"), "a", "b", F.lit(side).cast("long").alias("side"), n.alias("n"), nothing.alias("slots"), crc.alias("crc"))
    events = spread(mine, _LEFT, nothing, nothing).unionByName(spread(theirs, _RIGHT, F.col("n"), F.col("crc"))).unionByName(c_rows)
    swept = events.repartition("client", "shard").sortWithinPartitions("client", "shard", "a").mapInArrow(tidy(_swept), _OUT_DDL)
    return swept.repartition("client", "a", "b").groupBy("client", "a", "b", "relation").agg(*(F.sum(c).alias(c) for c in ("n", "slots", "crc")))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client, a, b): each sale's slots, from sold_at to the last shipped_at of its lines; b is null while it is open."""
    kind = dict(sales.dtypes)
    last = lines.filter("sale_id is not null").groupBy("sale_id").agg(F.max(micros(F.col("shipped_at"), dict(lines.dtypes)["shipped_at"])).alias("shipped"))
    own = sales.select("sale_id", F.col("client_id").cast("long").alias("client"), micros(F.col("sold_at"), kind["sold_at"]).alias("at"), (F.coalesce("status", F.lit("")) == "open").alias("open"))
    own = own.filter("client is not null and at is not null").join(last, "sale_id", "left")
    return own.select("sale_id", "client", floored(F.col("at"), SLOT).alias("a"), F.when(~F.col("open"), floored(F.greatest("at", F.coalesce("shipped", "at")), SLOT)).alias("b"))


def session_intervals(clicks: DataFrame) -> DataFrame:
    """(client, a, b, crc): each session's slots, b null while it is open, and the crc32 of its first timestamp."""
    own = clicks.select(F.col("client_id").cast("long").alias("client"), micros(F.col("ts"), dict(clicks.dtypes)["ts"]).alias("at"), (F.col("kind") == "error").alias("error"))
    found = sessions(own)
    return found.select("client", floored(F.col("first"), SLOT).alias("a"), F.when(~F.col("open"), floored(F.col("last"), SLOT)).alias("b"), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc"))


def sales_by_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of each row of sales and relation."""
    own = cut(sale_intervals(sales, lines))
    found = overlaps(own, session_intervals(clicks))
    # Joined by a start and end without nulls.
    bounded = lambda df: df.withColumn("b", F.coalesce("b", F.lit(_EVER)))
    rows = bounded(own).join(bounded(found), ["client", "a", "b"])
    return rows.select("sale_id", "relation", F.col("n").alias("n_pairs"), F.col("slots").alias("overlap_slots"), F.col("crc").alias("sessions_crc"))
