"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

Fit (bounded): centroids by spherical k-means and codebooks of the residuals on at most `sample_rows` vectors.
Index (all rows): each vector goes to its nearest centroid and its residual is coded in `parts` bytes.
Search: asymmetric distance tables (exact query part by codeword) score coded rows of the lists that a query visits, and
those that may be among its nearest are compared exactly, by the cosine of the original vectors.

What may be among them is bounded, not guessed: a code keeps how far its row lies from what it stands for, so a row's
cosine is its coded score give or take that distance, and none of a list's is above the centre's by more than the
list's farthest row lies from it. The sample's rows give each query a floor that its k-th nearest reaches, and each
slice of a list raises it. So the search is exact (as far as sums in another order go), and the index saves what its bounds let it save.
With exact=False it stops at guesses instead: the `probe_share` lists nearest to a query, and of each slice the `rerank` best codes.
Lists are cut into slices of at most `slice_rows` rows, queries of a list into blocks of `block_rows`, so a hot list is
many tasks. Vectors without any cluster structure need a large share; where lists are far apart, a small one does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut, tidy

SAMPLE_ROWS, SAMPLE_BYTES, PART_WIDTH, PROBE_SHARE, RERANK, MOST_LISTS = 16_384, 1 << 25, 2, 0.8, 200, 4096
SLICE_ROWS, BLOCK_ROWS = 16_384, 4096
#: What sums of single precision may be off by, and pairs that are compared exactly at a time.
SLACK, PAIRS = 2e-5, 65_536


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, computed so that neither very large nor very small components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 8192) -> np.ndarray:
    """Number of the centre nearest to each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + block] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), block)])


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Index:
    centres: np.ndarray  # lists x dim
    books: np.ndarray  # parts x 256 x dim of a part
    dim: int

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - self.dim))).reshape(len(x), self.books.shape[0], -1)

    def encode(self, x: np.ndarray):
        """List and code of unit vectors, their distance from what the code stands for, and from the list's centre."""
        own = nearest(x, self.centres)
        rest = self.split(x - self.centres[own])
        codes = np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)
        lost = rest - self.books[np.arange(codes.shape[1]), codes]
        size = lambda r: np.sqrt((r * r).sum(axis=(1, 2)))
        return own, codes, size(lost), size(rest)

    def probes(self, q: np.ndarray, share: float) -> np.ndarray:
        """The lists to visit for each query, nearest first."""
        n = max(1, math.ceil(share * len(self.centres)))
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :n]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """parts x codewords x queries: the products of each query's part with each codeword."""
        return np.einsum("qpd,pcd->pcq", self.split(q), self.books).astype(np.float32)

    def similarity(self, tables: np.ndarray, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """rows x queries, asymmetric: exact queries against coded rows, `own` being the list of each row."""
        out = (self.centres[own] @ q.T).astype(np.float32)
        for p in range(codes.shape[1]):
            out += tables[p][codes[:, p]]
        return out


def fit(x: np.ndarray, lists: int, parts: int | None = None, seed: int = 7) -> Index:
    """`parts` is the dimension by PART_WIDTH, if it isn't given."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    parts = min(parts or -(-dim // PART_WIDTH), dim)
    width = -(-dim // parts)
    centres = kmeans(x, lists, 8, rng, spherical=True)
    index = Index(centres, np.zeros((parts, 1, width)), dim)
    rest = index.split(x - centres[nearest(x, centres)])[:8192]
    k = min(256, len(rest))
    index.books = np.stack([kmeans(rest[:, p], k, 6, rng) for p in range(parts)])
    return index


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as double): rows with finite components, not all zero, of the most common length."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    )
    length = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    return rows.withColumn("n", F.lit(length["n"] if length else 0)).filter(F.size("embedding") == (length["dim"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(near: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each column; -inf where a column has fewer."""
    return np.partition(near, -k, axis=0)[-k] if len(near) >= k else np.full(near.shape[1], -np.inf, near.dtype)


def _blob(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS, lists: int | None = None, parts: int | None = None, probe_share: float = PROBE_SHARE, rerank: int = RERANK, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS, exact: bool = True) -> DataFrame:
    """The k nearest rows of `vectors` (vec_id, embedding) to each row of `queries`, its own vec_id excepted.

    Returns query_id, rank (from 1), vec_id, score (cosine in double precision on the original vectors), ties to the
    smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
    another length than the most common one, nor null ids. Of a vec_id that repeats among the queries the vector with
    the smallest components, compared in order, is searched; repeated rows of `vectors` are candidates each. No valid
    rows give no rows. Copies of one vector, however many, cost a query no more than k + 1 of them.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    rerank = max(rerank, k)
    first = rows.select(F.size("embedding").alias("dim")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Bounded by rows and by bytes: long vectors give fewer rows, but no fewer than there are codewords.
    sample_rows = max(256, min(sample_rows, SAMPLE_BYTES // (8 * first["dim"])))
    sample = bounded_sample(rows, "vec_id", sample_rows).select("vec_id", "embedding", "n").toPandas()
    x = unit(np.stack(sample["embedding"].to_numpy()))
    index = fit(x, lists or min(MOST_LISTS, max(1, math.isqrt(int(sample["n"][0])))), parts)
    known = sample["vec_id"].to_numpy()

    def encode(batches):
        for b in batches:
            if b.num_rows:
                raw = _matrix(b.column(1))
                own, codes, lost, far = index.encode(unit(raw))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0), _blob(codes), _blob(raw), pa.array(lost), pa.array(far)], names=["list", "vec_id", "code", "raw", "lost", "far"])

    # Of equal vectors only the k + 1 smallest ids, and of equal rows only k, can be among a query's k nearest.
    same = Window.partitionBy("embedding", "vec_id").orderBy("n"), Window.partitionBy("embedding").orderBy("vec_id")
    rows = rows.withColumn("i", F.row_number().over(same[0])).filter(F.col("i") <= k).withColumn("i", F.dense_rank().over(same[1])).filter(F.col("i") <= k + 1)
    coded = cut(rows.select("vec_id", "embedding").mapInArrow(tidy(encode), "list int, vec_id long, code binary, raw binary, lost double, far double").withColumn("row", F.monotonically_increasing_id()))
    # One number for each list.
    reach = np.full(len(index.centres), -np.inf)
    for r in coded.groupBy("list").agg(F.max("far").alias("far")).collect():
        reach[r["list"]] = r["far"]

    def probe(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                raw, ids = _matrix(some.column(1)), some.column(0).to_numpy(zero_copy_only=False)
                q = unit(raw)
                if exact:
                    floor = _best(np.where(known[:, None] != ids, x @ q.T, -np.inf), k) - SLACK
                    found = [np.flatnonzero(v) for v in q @ index.centres.T + reach >= floor[:, None]]
                else:
                    floor, found = np.full(len(q), -np.inf), index.probes(q, probe_share)
                yield pa.RecordBatch.from_arrays([some.column(0), _blob(raw), pa.array(floor), pa.array([v.tolist() for v in found], pa.list_(pa.int32()))], names=["query_id", "raw", "floor", "lists"])

    asked = valid(queries).filter(F.size("embedding") == index.dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = cut(asked.mapInArrow(tidy(probe), "query_id long, raw binary, floor double, lists array<int>"))
    probed = asked.select("query_id", "raw", "floor", F.explode("lists").alias("list"))
    # One row for each list, of which there are at most MOST_LISTS: small enough to broadcast.
    parts_of = lambda df, most, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    cuts = F.broadcast(parts_of(coded, slice_rows, "slices").join(parts_of(probed, block_rows, "blocks"), "list"))
    left = coded.join(cuts, "list").select("list", F.expr("int(pmod(xxhash64(row), slices))").alias("slice"), F.expr("explode(sequence(0, blocks - 1))").alias("block"), "vec_id", "code", "raw", "lost")
    right = probed.join(cuts, "list").select("list", F.expr("explode(sequence(0, slices - 1))").alias("slice"), F.expr("int(pmod(xxhash64(query_id), blocks))").alias("block"), "query_id", "raw", "floor")

    def rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows) and len(asked):
            own = np.full(len(rows), int(rows["list"].iloc[0]))
            ids, codes, lost = rows["vec_id"].to_numpy(), np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), rows["lost"].to_numpy()[:, None] + SLACK
            own_x = unit(np.frombuffer(b"".join(rows["raw"])).reshape(len(rows), -1))
            step = max(1, 2_000_000 // len(rows))
            for at in range(0, len(asked), step):
                some = asked.iloc[at : at + step]
                qids = some["query_id"].to_numpy()
                q = unit(np.frombuffer(b"".join(some["raw"])).reshape(len(qids), -1))
                near = index.similarity(index.tables(q), q, own, codes)
                near[ids[:, None] == qids[None, :]] = -np.inf
                if exact:
                    keep = near + lost >= np.maximum(_best(near - lost, k), some["floor"].to_numpy())
                else:
                    keep = near >= _best(near, rerank)
                r, c = np.nonzero(keep & (near > -np.inf))
                # Row by row in one order, so that copies of a vector score alike to the last bit.
                score = np.concatenate([np.zeros(0), *((own_x[r[i : i + PAIRS]] * q[c[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(r), PAIRS))])
                order = np.lexsort((ids[r], -score, c))
                place = np.arange(len(order)) - np.searchsorted(c[order], c[order])
                best = order[place < k]
                parts.append(pd.DataFrame({"query_id": qids[c[best]], "vec_id": ids[r[best]], "score": score[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    scored = left.groupBy("list", "slice", "block").cogroup(right.groupBy("list", "slice", "block")).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
