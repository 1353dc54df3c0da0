"""A stored index of vectors: navigable small-world graphs in shards, written beside a collection and read again.

Rows are dealt to shards by the hash of their key, some SHARD_ROWS rows each, however often a vector occurs. In a shard each row is linked
to near ones that are nearer to it than to each other, to the rows that chose it, and to FAR rows at random, which keep groups of
near rows within reach of each other. A shard is one row of a Parquet file of its own: adding rows writes new shards and
reads none of the stored ones but one that is not half full, whose rows go into the new ones. A search sends its queries to all shards, walks each graph from START rows on towards the query,
keeping the `breadth` best rows seen (more in larger shards), and merges the k best of all shards. Scores are exact cosines; which rows are scored is approximate.

Rows whose vector is null, has no direction (zero) or holds entries that aren't finite have no cosine and are in no shard.
Equal vectors are linked to a bounded number of each other, as any others are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import StorageError

SHARD_ROWS = 16_384
#: Nearest rows looked at for links, links a row chooses, random links, rows a walk starts from.
NEAR, LINKS, FAR, START = 24, 10, 1, 2
#: Rows that a walk keeps: so many, and one more for each so many rows of the shard.
BREADTH, ROWS_FOR_ONE = 14, 400
#: Bytes of queries that are sent to all tasks at a time.
QUERY_BYTES = 1 << 26
_SHARD = "shard long, n int, dim int, keys {}, vectors binary, links binary, ends binary"


def _links(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Numbers of the rows that each row of unit vectors is linked to."""
    n, rng = len(x), np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    if near < 1:
        return [np.empty(0, np.int32)] * n
    chosen = np.empty((n, near), np.int64)
    for at in range(0, n, 1024):
        score = x[at : at + 1024] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        some = np.argpartition(-score, near - 1, axis=1)[:, :near]
        order = np.argsort(-np.take_along_axis(score, some, axis=1), axis=1, kind="stable")
        chosen[at : at + 1024] = np.take_along_axis(some, order, axis=1)
    linked: list[set[int]] = [set() for _ in range(n)]
    for i, own in enumerate(chosen):
        among = x[own] @ x[own].T
        to_own = x[own] @ x[i]
        kept: list[int] = []
        for j in range(near):
            # Nearer to this row than to all that are linked already: another direction.
            if len(kept) < LINKS and not (among[j, kept] >= to_own[j]).any():
                kept.append(j)
        kept += [j for j in range(near) if j not in kept][: LINKS - len(kept)]
        for j in (*own[kept].tolist(), *rng.integers(0, n, FAR).tolist()):
            linked[i].add(j)
            linked[j].add(i)
    return [np.array(sorted(s - {i}), np.int32) for i, s in enumerate(linked)]


def walk(x: np.ndarray, links: np.ndarray, ends: np.ndarray, q: np.ndarray, breadth: int) -> tuple[list[tuple[float, int]], int]:
    """The best rows (score, row) that a walk towards a unit vector finds, and how many rows it scored."""
    seen = np.zeros(len(x), bool)
    first = np.unique(np.linspace(0, len(x) - 1, min(START, len(x))).astype(int))
    seen[first], scored = True, len(first)
    best = [(float(s), -int(i)) for s, i in zip(x[first] @ q, first)]
    ahead = [(-s, -i) for s, i in best]
    heapq.heapify(best)
    heapq.heapify(ahead)
    while len(best) > breadth:
        heapq.heappop(best)
    while ahead:
        s, i = heapq.heappop(ahead)
        if len(best) >= breadth and -s < best[0][0]:
            break
        near = links[ends[i] : ends[i + 1]]
        near = near[~seen[near]]
        seen[near], scored = True, scored + len(near)
        for s, j in zip((x[near] @ q).tolist(), near.tolist()):
            if len(best) < breadth or s > best[0][0]:
                heapq.heappush(best, (s, -j))
                heapq.heappush(ahead, (-s, j))
                if len(best) > breadth:
                    heapq.heappop(best)
    return [(s, -i) for s, i in best], scored


class GraphIndex:
    """Opened by its path; `key` names the column of ids."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._there = lambda part: self._fs.exists(place(f"{self.path}/{part}/_SUCCESS"))

    def shards(self) -> DataFrame | None:
        """The shards that count: those whose rows went into later ones are listed as retired."""
        if not self._there("shards"):
            return None
        stored = self.spark.read.parquet(f"{self.path}/shards")
        # One retired shard for each call of add() at most.
        return stored.join(F.broadcast(self.spark.read.parquet(f"{self.path}/retired")), "shard", "left_anti") if self._there("retired") else stored

    def count(self) -> int:
        """Rows in all shards."""
        stored = self.shards()
        return (stored.agg(F.sum("n")).first()[0] or 0) if stored is not None else 0

    def add(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        """Write shards of vectors (key, embedding). Vectors of another length than the stored ones are refused."""
        unusable = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        own = vectors.select(self.key, F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", unusable) & F.exists("v", lambda x: x != 0))
        facts = own.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
        if not facts["n"]:
            return
        stored, first, rows, old = self.shards(), 0, facts["n"], []
        kind = own.schema[self.key].dataType.simpleString()
        if stored is not None:
            first = self.spark.read.parquet(f"{self.path}/shards").agg(F.max("shard")).first()[0] + 1
            # All shards of one call are alike in size, so no more than one of all is less than half full.
            part = stored.filter(F.col("n") < shard_rows // 2)
            old = part.select("shard", "n").collect()
            rows += sum(r["n"] for r in old)
            own = own.unionByName(self._rows(part, kind)) if old else own
        dims = {facts["least"], facts["most"]} | ({stored.first()["dim"]} if stored is not None else set())
        if len(dims) > 1:
            raise StorageError(f"the vectors have {', '.join(map(str, sorted(dims)))} dimensions; an index has one")
        many = -(-rows // shard_rows)
        key = self.key

        def build(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            ids, v = table[key].combine_chunks(), table["v"].combine_chunks()
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            linked = _links(x / np.linalg.norm(x, axis=1, keepdims=True), shard)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in linked])]).astype(np.int32)
            row = {"shard": [shard], "n": [len(ids)], "dim": [x.shape[1]], "keys": [ids.to_pylist()], "vectors": [x.astype("<f8").tobytes()], "links": [np.concatenate(linked).astype("<i4").tobytes()], "ends": [ends.astype("<i4").tobytes()]}
            return pa.table({c: pa.array(a, t) for (c, a), t in zip(row.items(), (pa.int64(), pa.int32(), pa.int32(), pa.list_(ids.type), pa.binary(), pa.binary(), pa.binary()), strict=True)})

        dealt = own.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(many)) + first)
        built = dealt.groupBy("shard").applyInArrow(build, _SHARD.format(f"array<{kind}>"))
        built.write.mode("append").option("maxRecordsPerFile", 1).parquet(f"{self.path}/shards")
        if old:
            self.spark.createDataFrame([(r["shard"],) for r in old], "shard long").coalesce(1).write.mode("append").parquet(f"{self.path}/retired")

    def _rows(self, shards: DataFrame, kind: str) -> DataFrame:
        """(key, v) of the rows of shards."""
        key = self.key

        def run(batches):
            for b in batches:
                for keys, dim, vectors in zip(*(b.column(i) for i in range(3)), strict=True):
                    x = np.frombuffer(vectors.as_py(), "<f8").reshape(-1, dim.as_py())
                    yield pa.RecordBatch.from_arrays([keys.values, pa.array(list(x), pa.list_(pa.float64()))], names=[key, "v"])

        return shards.select("keys", "dim", "vectors").mapInArrow(run, f"`{key}` {kind}, v array<double>")

    def search(self, queries: DataFrame, k: int = 5, breadth: int | None = None, block_bytes: int = QUERY_BYTES) -> DataFrame:
        """The k best rows found for each query (query_id, q): query_id, rank, key, score, scored (rows scored for that query)."""
        stored = self.shards()
        names = queries.schema["query_id"].dataType.simpleString()
        if stored is None:
            raise StorageError("the index is empty")
        kind = stored.schema["keys"].dataType.elementType.simpleString()
        arrow = to_arrow_type(stored.schema["keys"].dataType.elementType)
        dim = stored.first()["dim"]
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter(F.size("q") == dim)
        blocks, out, key = max(1, -(-asked.count() * dim * 8 // block_bytes)), None, self.key
        for b in range(blocks):
            table = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            q = np.array(table["q"].to_pylist(), float).reshape(-1, dim)
            size = np.linalg.norm(q, axis=1, keepdims=True)
            shared = self.spark.sparkContext.broadcast((table["query_id"].combine_chunks(), np.divide(q, size, out=np.zeros_like(q), where=size > 0)))

            def run(batches, shared=shared):
                ids, q = shared.value
                best: list[list] = [[] for _ in q]
                scored = np.zeros(len(q), np.int64)
                for batch in batches:
                    for keys, vectors, links, ends in zip(*(batch.column(i) for i in range(4)), strict=True):
                        x = np.frombuffer(vectors.as_py(), "<f8").reshape(-1, dim)
                        x, keys = x / np.linalg.norm(x, axis=1, keepdims=True), keys.as_py()
                        links, ends = np.frombuffer(links.as_py(), "<i4"), np.frombuffer(ends.as_py(), "<i4")
                        wide = max(k, breadth or BREADTH + len(x) // ROWS_FOR_ONE)
                        for i, own in enumerate(q):
                            found, n = walk(x, links, ends, own, wide)
                            scored[i] += n
                            best[i] = heapq.nsmallest(k, [*best[i], *((-s, keys[j]) for s, j in found)])
                where = [i for i, own in enumerate(best) for _ in own]
                flat = [pair for own in best for pair in own]
                first = np.array([j == 0 for own in best for j in range(len(own))], bool)
                count = np.where(first, scored[where], 0) if where else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), pa.array([p[1] for p in flat], arrow), pa.array([-p[0] for p in flat], pa.float64()), pa.array(count, pa.int64())], names=["query_id", key, "score", "scored"])

            found = stored.select("keys", "vectors", "links", "ends").mapInArrow(run, f"query_id {names}, `{key}` {kind}, score double, scored long")
            out = found if out is None else out.unionByName(found)
        w = Window.partitionBy("query_id")
        rows = out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), key))).withColumn("scored", F.sum("scored").over(w))
        return rows.filter(F.col("rank") <= k).select("query_id", "rank", key, "score", "scored")
