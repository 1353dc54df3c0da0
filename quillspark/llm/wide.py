"""Near-duplicates by SimHash where texts count as such at a similarity of their shingles, not at a radius.

Texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Words are those of simhash
(bytes A-Z lower-cased, runs of bytes other than blank and 0x09-0x0D); a text of fewer than five words is one shingle.
At 0.8 fingerprints of such sets differ in some 10 of 64 bits, and in up to RADIUS of them. Blocks of a fingerprint can't
route so wide a radius, so the shards of the BK-trees are formed by other keys: each set has BANDS keys of ROWS minima of
its shingles' hashes each; sets with an equal key share a shard, its tree finds those within RADIUS bits, and the exact
similarity of the whole sets decides on each pair that a tree finds; none is estimated.

Two approximations, both computed for a similarity of exactly 0.8: a pair shares no key with probability
(1 - 0.8^ROWS)^BANDS = 0.00007 (at 0.9: 10^-9), and its fingerprints are more than RADIUS bits apart, more than four
standard deviations from the mean, with some 0.00002.

Large groups of near copies must not make a square of rows. First each set is compared with one other, the smallest
among those it shares a shard with; a pair within a component changes no component and is left out from then on. Shards
that hold several components still are searched in full: the whole sets meet in the shard's task, its tree finds who is
near, and sets that are linked already, through whatever others, are not compared again. Only links leave the task, at
most one for each set. A shard beyond `shard_size` sets or SHINGLES shingles is cut into shards of that size of which every pair meets. A pair that
shares several shards is compared in the one with the smallest key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEYS, WordHashes, cut, tidy
from .simhash import _MASK, BKTree, Groups, components

WIDTH = 5
BANDS, ROWS, RADIUS = 24, 5, 22
#: Shingles of a shard's sets together, from which on the shard is cut: some 16 MB.
SHINGLES = 2_000_000
#: Odd factors: each orders the hashes of shingles anew.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("sid", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
SETS = pa.schema([("sid", pa.int64()), ("set", pa.list_(pa.int64()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted set of hashed shingles of a whole text; a text without words has one, of no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    h = hashes.array(words)
    n = len(h) - WIDTH + 1
    out = h[:n].copy()
    for i in range(1, WIDTH):
        out = out * STEP + h[i : i + n]
    return np.unique(_mixed(out))


def minima(found: np.ndarray, block: int = 2048) -> np.ndarray:
    """BANDS keys of a set: each hashes ROWS minima and the number of the band."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(found), block):
        np.minimum(low, np.multiply.outer(FACTORS, found[at : at + block]).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = _mixed(key * STEP + part)
    return key.view(np.int64)


def _sid(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 42) - (1 << 63)


def fingerprint(found: np.ndarray, block: int = 100_000) -> int:
    """The fingerprint, as a signed number, of a set of hashed shingles: a bit is set if it is in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), block):
        ones += np.unpackbits(found[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big", signed=True)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h: hash of the text, sid: hash of its set, fp: its fingerprint, keys): one row for each row of docs."""

    def run(batches):
        hashes = WordHashes(50_000)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sids, prints, keys = [], [], []
                for t in b.column(2):
                    found = shingles(t.as_py(), hashes)
                    sids.append(_sid(found))
                    prints.append(fingerprint(found))
                    keys.append(minima(found))
                lists = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(keys) + 1, BANDS), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sids, pa.int64()), pa.array(prints, pa.int64()), lists], schema=SIGNED)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text")).mapInArrow(tidy(run), "doc_id long, h long, sid long, fp long, keys array<long>")


def _sets(docs: DataFrame, marks: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, set) for the given sids, from one text of each."""
    one = cut(marks.select("sid", "h").join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("h").alias("h")))
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    texts = texts.join(F.broadcast(one) if one.count() <= MOST_KEYS else one, "h").groupBy("sid").agg(F.first("text").alias("text"))

    def run(batches):
        hashes = WordHashes(50_000)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [pa.array(shingles(t.as_py(), hashes).view(np.int64)) for t in b.column(1)]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found))], schema=SETS)

    return cut(texts.mapInArrow(tidy(run), "sid long, set array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar: shared shingles by those of either, in whole thousandths."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("y")), "b")
    m, n, least = F.size("x"), F.size("y"), round(1000 * similarity)
    shared = F.size(F.array_intersect("x", "y"))
    near = (F.least(m, n) * 1000 >= F.greatest(m, n) * least) & (shared * 1000 >= (m + n - shared) * least)
    return cut(both.filter(near).select("a", "b"))


class Shard:
    """The members of one side of a shard, and where each shingle occurs among them."""

    def __init__(self, members: pa.Table):
        get = lambda name: members[name].combine_chunks()
        self.fp, self.c = [x & _MASK for x in get("fp").to_pylist()], get("c").to_pylist()
        self.keys = [frozenset(k) for k in get("keys").to_pylist()]
        sets = get("set")
        self.flat, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        spread = np.concatenate([self.flat[a : a + n] for a, n in zip(self.starts, self.sizes)]) if len(self.c) else self.flat[:0]
        order = np.argsort(spread, kind="stable")
        self.sorted, self.owner = spread[order], np.repeat(np.arange(len(self.c)), self.sizes)[order]

    def set(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def shared(self, other: np.ndarray) -> np.ndarray:
        """How many shingles of a set each member shares with it: exact, by the places of those shingles."""
        low, high = np.searchsorted(self.sorted, other, "left"), np.searchsorted(self.sorted, other, "right")
        n = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[places], minlength=len(self.c))


def _links(key: int, tree_side: Shard, asked: Shard, within: bool, least: int):
    """(larger, smaller) components that a pair of similar sets links: a forest, so at most one link for each."""
    tree, at, own = BKTree(), {}, Groups()
    for i, f in enumerate(tree_side.fp):
        tree.add(f)
        at.setdefault(f, []).append(i)
    for i, f in enumerate(asked.fp):
        n, c = int(asked.sizes[i]), asked.c[i]
        near = [
            j for g in tree.within(f, RADIUS) for j in at[g]
            if c != tree_side.c[j] and (not within or j < i) and min(n, m := int(tree_side.sizes[j])) * 1000 >= max(n, m) * least and own.find(c) != own.find(tree_side.c[j]) and min(asked.keys[i] & tree_side.keys[j]) == key
        ]
        shared = tree_side.shared(asked.set(i)) if near else ()
        for j in near:
            both = int(shared[j])
            if both * 1000 >= (n + int(tree_side.sizes[j]) - both) * least and own.find(c) != own.find(tree_side.c[j]):
                own.join(c, tree_side.c[j])
                yield max(c, tree_side.c[j]), min(c, tree_side.c[j])


def _searched(rows: DataFrame, sets: DataFrame, similarity: float, shard_size: int) -> DataFrame:
    """(a, b): links between different components that the trees of the shards find; rows are (key, sid, fp, c, keys)."""
    rows = rows.join(sets.select("sid", F.size("set").alias("n")), "sid")
    parts = F.greatest(F.count(F.lit(1)) / shard_size, F.sum("n") / SHINGLES)
    dealt = rows.join(rows.groupBy("key").agg(F.ceil(parts).cast("int").alias("shards")), "key")
    dealt = dealt.withColumn("s", F.expr("int(pmod(xxhash64(sid), shards))")).withColumn("t", F.explode(F.expr("sequence(0, shards - 1)")))
    dealt = dealt.join(sets, "sid").select("key", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), (F.col("s") > F.col("t")).alias("far"), "fp", "c", "keys", "set")
    least = round(1000 * similarity)

    def run(group, rows):
        # One shard, or one pair of shards, at a time: what a task holds has their bound.
        key, p, q = (x.as_py() for x in group)
        near = Shard(rows.filter(pc.invert(rows["far"])))
        pairs = list(_links(key, near, near if p == q else Shard(rows.filter(rows["far"])), p == q, least))
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return dealt.groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, marks: DataFrame, similarity: float, shard_size: int) -> DataFrame:
    """(a, b) of sids that connect all similar sets that meet; marks are signed(docs)."""
    rows = marks.select("sid", "fp", F.explode("keys").alias("key")).distinct()
    lead = rows.groupBy("key").agg(F.min("sid").alias("lead"), F.max("sid").alias("most")).filter("lead < most").select("key", "lead")
    rows = cut(rows.join(lead, "key"))
    sets = _sets(docs, marks, rows.select("sid").distinct())
    first = rows.filter("sid <> lead").groupBy("sid").agg(F.min("lead").alias("b")).select(F.col("sid").alias("a"), "b")
    whole = components(_verified(first, sets, similarity))
    rows = rows.join(whole.select(F.col("a").alias("sid"), F.col("b").alias("c")), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    split = rows.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q")).filter("p < q").select("key")
    rows = cut(rows.join(split, "key", "left_semi").select("key", "sid", "fp", "c"))
    keys = rows.groupBy("sid").agg(F.collect_set("key").alias("keys"))
    return whole.select("a", "b").union(_searched(rows.join(keys, "sid"), sets, similarity, shard_size))


def near_duplicates(docs: DataFrame, similarity: float, shard_size: int) -> DataFrame:
    """What simhash.near_duplicates returns, by the texts' similarity."""
    marks = cut(signed(docs))
    roots = components(links(docs, marks, similarity, shard_size)).select(F.col("a").alias("sid"), F.col("b").alias("root"))
    nodes = marks.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("fp").alias("fp")).join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    classes = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(classes, "root").select("sid", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
    return marks.select("doc_id", "sid").join(nodes, "sid").select("doc_id", "fingerprint", "component_id", "copies")
