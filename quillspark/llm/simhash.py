"""SimHash near-duplicates: 64-bit fingerprints, BK-tree shards, connected components.

Fingerprint: bytes A-Z lower-cased, words are runs of bytes other than blank and 0x09-0x0D, shingles of
three words (all words, if fewer) hashed by XXH64 with seed 42; a bit is set if it is set in over half the hashes.
Documents link when fingerprints differ in at most `radius` bits.

Search: two fingerprints within 3 bits agree on one of four 16-bit blocks, and in the remaining 48 bits on one of
four 12-bit blocks, so each fingerprint goes to 16 buckets keyed by 28 of its bits. A bucket is a shard with a
BK-tree of its own; only buckets with two or more fingerprints are kept. Where these hold at most `most_trees`
fingerprints in all, counted first, the shards are broadcast: each process builds a shard's tree once and searches it for
the fingerprints of its own rows. Beyond that bound, as trees grow with the corpus, they are routed instead: a bucket
meets in one task, and one beyond `shard_size` is cut into shards of that size of which every pair meets (tree of the
one, queries from the other), so nothing is dropped. Both ways give the same links.

Each shard emits only a star for each group that it finds, never all pairs. At most MOST_EDGES links, counted first, are
joined to components in one task; more by alternating large and small stars, with reliable checkpoints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_copies, tidy

RADIUS = 3
SHARD_SIZE = 2048
#: The most fingerprints in shard trees that are broadcast: some 16 MB as trees in each process.
MOST_TREES = 100_000
#: The most links that one task joins: some 100 MB as disjoint sets.
MOST_EDGES = 200_000
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, block: int = 100_000) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, n, digest, join = np.zeros(64, np.int64), len(words) - 2, xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, block):
        part = words[at : at + block + 2]
        hashes = np.array([digest(s, 42) for s in map(join, zip(part, part[1:], part[2:]))], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp signed long): one row for each row of docs, null texts and null ids included."""

    def run(batches):
        for b in batches:
            fps = [f - (1 << 64) if f >= 1 << 63 else f for f in map(fingerprint, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], schema=FINGERPRINTS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent; a search follows only edges within the radius."""

    def __init__(self):
        self.root = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while True:
            d = (value ^ x).bit_count()
            if d == 0:
                return
            child = children.get(d)
            if child is None:
                children[d] = (x, {})
                return
            value, children = child

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            for e, child in children.items():
                if -radius <= d - e <= radius:
                    todo.append(child)
        return found


class Groups:
    """Disjoint sets of numbers, each known by its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """(member, smallest member) of each group."""
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def stars(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each linked group: within left, or between left and right."""
    groups, tree = Groups(), BKTree()
    if right is not None:
        for x in left:
            tree.add(x)
    for x in left if right is None else right:
        for y in tree.within(x, radius):
            groups.join(x, y)
        if right is None:
            tree.add(x)
    return groups.stars()


def _buckets(fps: DataFrame) -> DataFrame:
    keys = []
    for i in range(4):
        turned = F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i)) if i else F.col("fp")
        for j in range(4):
            sub = F.shiftrightunsigned(turned, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28).cast("long") + F.shiftrightunsigned(turned, 48) * F.lit(1 << 12) + sub)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edges(pairs) -> pa.RecordBatch:
    pairs = [(_signed(x), _signed(y)) for x, y in pairs]
    return pa.RecordBatch.from_arrays([pa.array([max(x) for x in pairs], pa.int64()), pa.array([min(x) for x in pairs], pa.int64())], schema=EDGES)


def links(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, most_trees: int = MOST_TREES) -> DataFrame:
    """Stars (a, b), a > b, over distinct fingerprints `fp`, that connect all within the radius (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3: the buckets find no further links")
    rows = _buckets(fps)
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = cut(rows.join(full, "key"))
    found = _broadcast(rows, radius) if rows.count() <= most_trees else _routed(rows, radius, shard_size)
    return found.distinct()


def _broadcast(rows: DataFrame, radius: int) -> DataFrame:
    shards: dict[int, list[int]] = {}
    for r in rows.select("key", "fp").collect():
        shards.setdefault(r["key"], []).append(r["fp"] & _MASK)
    shared = rows.sparkSession.sparkContext.broadcast({k: sorted(x) for k, x in shards.items()})

    def run(batches):
        trees: dict[int, BKTree] = {}
        for b in batches:
            groups = Groups()
            for key, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key not in trees:
                    trees[key] = BKTree()
                    for x in shared.value[key]:
                        trees[key].add(x)
                for y in trees[key].within(fp & _MASK, radius):
                    groups.join(fp & _MASK, y)
            yield _edges(groups.stars())

    # By key, so that a tree is built in one process.
    return rows.select("key", "fp").repartition("key").mapInArrow(tidy(run), "a long, b long")


def _routed(rows: DataFrame, radius: int, shard_size: int) -> DataFrame:
    rows = (
        rows.withColumn("shards", F.ceil(F.col("n") / shard_size).cast("int"))
        .withColumn("s", F.expr("int(pmod(xxhash64(fp), shards))"))
        .withColumn("t", F.explode(F.expr("sequence(0, shards - 1)")))
        .select("key", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), (F.col("s") > F.col("t")).alias("far"), "fp")
    )
    groups = rows.groupBy("key", "p", "q").agg(
        F.collect_list(F.when(~F.col("far"), F.col("fp"))).alias("near"), F.collect_list(F.when(F.col("far"), F.col("fp"))).alias("away")
    )

    def run(batches):
        for b in batches:
            out = set()
            for p, q, near, away in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                near, away = [x & _MASK for x in near], [x & _MASK for x in away]
                out.update(stars(near, None if p == q else away, radius))
            yield _edges(out)

    return groups.select("p", "q", "near", "away").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(a, b): each node of the edges but the smallest of its component, with that smallest node."""
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = cut(edges.filter("a <> b"))
    now = state(edges)
    if now[0] <= most_edges:

        def run(batches):
            groups = Groups()
            for b in batches:
                for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    groups.join(x, y)
            found = groups.stars()
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found[i : i + 100_000])], schema=EDGES)

        return cut(edges.select("a", "b").repartition(1).mapInArrow(tidy(run), "a long, b long"))
    while now[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = cut(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, state(edges)
        if now == before:
            break
    return edges


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, similarity: float | None = None, most_trees: int = MOST_TREES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, copies.

    component_id is the smallest doc_id reachable over links; copies counts the rows with the same fingerprint.
    Null or empty texts have fingerprint zero and link like any other. A null doc_id keeps its row; a component
    with null ids only has a null component_id. Repeated rows link to each other. No rows give no rows.
    With a `similarity` the texts' sets of five-word shingles decide instead of the radius: see wide.py.
    """
    if similarity is not None:
        from . import wide

        return wide.near_duplicates(docs, similarity, shard_size)
    fp = cut(fingerprints(docs))
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    star = components(links(nodes.select("fp"), radius, shard_size, most_trees))
    nodes = nodes.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(classes, "root").select("fp", "component_id", "copies")
    return join_copies(fp, nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
