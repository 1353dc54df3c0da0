"""Exact and indexed nearest-vector search, pair comparison, neighbour graph and projection.

Vectors are rows (id, embedding). Ties keep input order, which is the order of `ordinal` if there is such a column,
else of the id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RetrievalError
from ..functions import vectors as V
from . import neighbours
from .index import GraphIndex
from .ranges import running

#: Name: (label, score, whether a larger score is nearer).
METHODS = {
    "cosine": ("Cosine similarity", V.cosine_similarity, True),
    "euclidean": ("Euclidean distance", V.euclidean_distance, False),
}


def check_top_k(k) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise RetrievalError(f"top_k must be a whole number of at least 1, not {k!r}")


def check_method(name: str) -> None:
    if name not in METHODS:
        raise RetrievalError(f"unknown method {name!r}; there are {', '.join(METHODS)}")


def check_query(text) -> None:
    if not isinstance(text, str) or not text.strip():
        raise RetrievalError("the question is empty")


def _order(score: Column, larger: bool, tie: str) -> list[Column]:
    return [score.desc_nulls_last() if larger else score.asc_nulls_last(), F.col(tie)]


def _tie(df: DataFrame, key: str) -> str:
    return "ordinal" if "ordinal" in df.columns else key


def search(vectors: DataFrame, query: list[float], k: int = 5, method: str = "cosine", key: str = "chunk_id") -> DataFrame:
    """The k nearest rows to one vector: rank, score and the row. Partial top-k for each partition, then a merge."""
    check_top_k(k)
    check_method(method)
    _, score, larger = METHODS[method]
    spark = vectors.sparkSession
    q = spark.createDataFrame([([float(x) for x in query],)], "q array<double>")
    scored = vectors.crossJoin(F.broadcast(q)).withColumn("score", score(F.col("embedding"), F.col("q"))).drop("q")
    top = scored.orderBy(*_order(F.col("score"), larger, _tie(vectors, key))).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*_order(F.col("score"), larger, _tie(vectors, key)))))


#: Bytes of a block of query vectors that is sent to all tasks, and products that a task holds at a time.
QUERY_BYTES, CELLS = 1 << 26, 4_000_000
#: Where all rows are queries: bytes of vectors on either side of a task, and the fewest rows that are worth a block.
SIDE_BYTES, SIDE_ROWS = 1 << 23, 1024


def _dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix, and which of them are vectors of that length without nulls; others are zeros."""
    flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if not flat.null_count and (sizes == dim).all():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dim), np.ones(len(column), bool)
    rows = [r if r is not None and len(r) == dim and None not in r else None for r in column.to_pylist()]
    good = np.array([r is not None for r in rows], bool)
    return np.array([r if r is not None else [0.0] * dim for r in rows]).reshape(-1, dim), good


def _first_of_equal(x: np.ndarray, k: int) -> np.ndarray:
    """Rows but those that have k equal ones before them: no query has more than k equal rows among its k nearest."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    first = np.searchsorted(same[order], np.arange(len(x)))
    return np.sort(order[np.arange(len(x)) - first[same[order]] < k])


def _scores(x: np.ndarray, q: np.ndarray, method: str) -> np.ndarray:
    """Scores of pairs of rows, summed pair by pair, so that copies of a vector score alike to the last bit."""
    if method == "cosine":
        return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _nearest(x: np.ndarray, good: np.ndarray, q: np.ndarray, known: np.ndarray, k: int, method: str, digits: int | None = None, floor: np.ndarray | None = None):
    """(query, row, score): for each query at least its k nearest rows and at most 4 k; rows are in the order that breaks ties.

    A matrix product finds who can be among them; only their scores are summed. Where more than 4 k come too near each other, all of these
    are scored and k kept, by `digits` decimal places if given. Rows without a score (null, not finite, or zero for the
    cosine) come last, with NaN. floor holds for each query what the k nearest of a task's earlier rows reach; rows below it are left
    out, and it is raised here.
    """
    cosine, step = method == "cosine", 0.0 if digits is None else 10.0**-digits
    fine = good & np.isfinite(x).all(axis=1) & ((x != 0).any(axis=1) | (not cosine))
    asked = known & np.isfinite(q).all(axis=1) & ((q != 0).any(axis=1) | (not cosine))
    rows, rest = np.flatnonzero(fine), np.flatnonzero(~fine)
    if len(rows):
        rows = rows[_first_of_equal(x[rows], k)]
    own, queries = x[rows], np.flatnonzero(asked)
    lacking = k - len(rows)
    # Queries without a score for any row have the first k rows; others have rows without a score only if there are too few.
    none = np.flatnonzero(~asked)
    some = [(np.repeat(none, min(k, len(x))), np.tile(np.arange(min(k, len(x))), len(none)), None)]
    if lacking > 0:
        some.append((np.repeat(queries, len(rest[:lacking])), np.tile(rest[:lacking], len(queries)), None))
    if len(rows) and len(queries):
        p = q[queries]
        xx, qq = (own * own).sum(axis=1), (p * p).sum(axis=1)
        if cosine:
            near = (own / np.sqrt(xx)[:, None]) @ (p / np.sqrt(qq)[:, None]).T
            slack = 1e-9 + step
        else:
            near = 2 * (own @ p.T) - xx[:, None] - qq
            size = 1 + xx.max() + qq.max()
            slack = 1e-9 * size + 4 * step * (np.sqrt(size) + step)
        least = np.full(len(p), -np.inf) if floor is None else floor[queries]
        if lacking <= 0:
            # Only queries with k rows above their floor can raise it.
            up = np.flatnonzero((near > least).sum(axis=0) >= k)
            if len(up):
                own_least = np.partition(np.ascontiguousarray(near[:, up].T), -k, axis=1)[:, -k]
                if floor is not None:
                    floor[queries[up]] = np.fmax(least[up], own_least - slack)
                least[up] = np.fmax(least[up], own_least)
        near = near >= least - slack
        many = near.sum(axis=0) > 4 * k
        for j in np.flatnonzero(many):
            i = np.flatnonzero(near[:, j])
            score = _scores(own[i], p[j][None], method)
            score = score if digits is None else np.floor(score / step + 0.5)
            i = i[np.lexsort((i, -score if cosine else score))[:k]]
            some.append((np.full(len(i), queries[j]), rows[i], _scores(own[i], p[j][None], method)))
        r, c = np.nonzero(near & ~many)
        some.append((queries[c], rows[r], _scores(own[r], p[c], method)))
    return (*(np.concatenate([s[i] for s in some]).astype(int) for i in (0, 1)), np.concatenate([np.full(len(s[0]), np.nan) if s[2] is None else s[2] for s in some]))


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, method: str = "cosine", key: str = "vec_id", block_bytes: int = QUERY_BYTES, digits: int | None = None) -> DataFrame:
    """The k nearest rows for each of a stated set of queries (query_id, q): query_id, rank, key, score.

    Every query is compared with every row: exact, and a report. Queries go to the tasks in blocks of at most
    `block_bytes`, one pass over the rows for each; a task keeps at most 4 k rows a query of each batch of its rows, however
    many tie. Ranks go by the score, by its first `digits` decimal places if that is given, and then by the key.
    """
    check_top_k(k)
    check_method(method)
    larger = METHODS[method][2]
    own = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    first = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dim")).first()
    n, dim = first["n"], max(1, first["dim"] or 1)
    blocks, out = max(1, -(-n * dim * 8 // block_bytes)), None
    kinds = [f.dataType.simpleString() for f in (own.schema["query_id"], vectors.schema[key])]
    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    for b in range(blocks):
        table = (own if blocks == 1 else own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        ids = table["query_id"].combine_chunks()
        matrix, known = _dense(table["q"].combine_chunks(), dim)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, known))

        def run(batches, shared=shared):
            ids, q, known = shared.value
            floor = np.full(len(q), -np.inf)
            for batch in batches:
                step = max(1, CELLS // max(1, batch.num_rows))
                # Ties go to the smaller key.
                batch = batch.take(pc.sort_indices(batch.column(0)))
                x, good = _dense(batch.column(1), dim)
                for at in range(0, len(q) if batch.num_rows else 0, step):
                    c, r, score = _nearest(x, good, q[at : at + step], known[at : at + step], k, method, digits, floor[at : at + step])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(c + at)), batch.column(0).take(pa.array(r)), pa.array(score, from_pandas=True)], names=["query_id", key, "score"])

        top = rows.mapInArrow(run, f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double")
        out = top if out is None else out.unionByName(top)
    w = Window.partitionBy("query_id").orderBy(*_order(F.col("score") if digits is None else F.round("score", digits), larger, key))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _cells(batches):
    """(keys, vectors of the queries, batches of rows) of each run of rows (cell, asked, key, embedding) with one cell, queries first."""
    cell, held, last = None, [], None
    for batch in batches:
        at, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            piece = batch.slice(lo, hi - lo).select([2, 3])
            if at[lo] != cell:
                cell, held, last = at[lo], [], None
            if asked[lo]:
                held.append(piece)
            elif held:
                if last is None:
                    last = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield cell, last, piece


def search_all(vectors: DataFrame, k: int = 5, method: str = "cosine", key: str = "vec_id", side_bytes: int = SIDE_BYTES) -> DataFrame:
    """search_many() with every row as a query: query_id, rank, key, score. No vector passes through the driver.

    Queries and rows are dealt into blocks, and a task compares a block of queries with a block of rows, each of at most about
    `side_bytes`. All pairs are compared, so time is quadratic, and so is what is shuffled: both sides once for each block of the other.
    """
    check_top_k(k)
    check_method(method)
    larger = METHODS[method][2]
    kind = vectors.schema[key].dataType.simpleString()
    first = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = first["n"], max(1, first["dim"] or 1)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = min(max(-(-n * dim * 8 // side_bytes), math.isqrt(2 * cores) + 1), -(-n // SIDE_ROWS)) or 1
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    # Tasks take single or double precision as it is.
    vector = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    one = vectors.select(F.col(key).alias("key"), vector.alias("embedding"), own.alias("own"), other)
    asked = one.select((F.col("own") * blocks + F.col("other")).alias("cell"), F.lit(True).alias("asked"), "key", "embedding")
    rows = one.select((F.col("other") * blocks + F.col("own")).alias("cell"), F.lit(False).alias("asked"), "key", "embedding")

    def run(batches):
        cell, q, known, floor, ids = None, None, None, None, None
        for at, queries, batch in _cells(batches):
            if at != cell:
                cell, ids = at, queries.column(0)
                q, known = _dense(queries.column(1).cast(pa.list_(pa.float64())), dim)
                floor = np.full(len(q), -np.inf)
            # Ties go to the smaller key.
            batch = batch.take(pc.sort_indices(batch.column(0)))
            x, good = _dense(batch.column(1).cast(pa.list_(pa.float64())), dim)
            step = max(1, CELLS // batch.num_rows)
            for lo in range(0, len(q), step):
                c, r, score = _nearest(x, good, q[lo : lo + step], known[lo : lo + step], k, method, None, floor[lo : lo + step])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c + lo)), batch.column(0).take(pa.array(r)), pa.array(score, from_pandas=True)], names=["query_id", key, "score"])

    met = asked.unionByName(rows).repartitionById(blocks * blocks, F.col("cell").cast("int")).sortWithinPartitions("cell", F.desc("asked"))
    out = met.mapInArrow(run, f"query_id {kind}, `{key}` {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(*_order(F.col("score"), larger, key))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def retrieve(vectors: DataFrame, question: str, embedder, k: int = 5, method: str = "cosine", key: str = "chunk_id") -> DataFrame:
    """Embed the question once and search."""
    check_query(question)
    check_top_k(k)
    check_method(method)
    return search(vectors, _embedded(vectors, question, embedder), k, method, key)


def report(found: DataFrame, key: str = "chunk_id", digits: int = 4) -> DataFrame:
    """(rank, line): a search's rows as lines for people to read; at most k rows, so the caller may print them."""
    return found.select("rank", F.concat(F.lpad(F.col("rank").cast("string"), 3, " "), F.lit("  "), F.format_string(f"%.{digits}f", F.col("score")), F.lit("  "), F.col(key).cast("string")).alias("line"))


def retrieve_all_methods(vectors: DataFrame, question: str, embedder, k: int = 5, key: str = "chunk_id") -> dict[str, DataFrame]:
    """One embedding, one ranking for each method."""
    check_query(question)
    check_top_k(k)
    q = _embedded(vectors, question, embedder)
    return {m: search(vectors, q, k, m, key) for m in METHODS}


def _embedded(vectors: DataFrame, question: str, embedder) -> list[float]:
    first = vectors.select(F.size("embedding").alias("n")).first()
    if first is None:
        raise RetrievalError("there are no stored vectors")
    q = embedder.embed([question])[0]
    if len(q) != first["n"]:
        raise RetrievalError(f"the question has {len(q)} dimensions, the stored vectors have {first['n']}")
    return q


def ranked(df: DataFrame, by: str, larger: bool, tie: str, name: str) -> DataFrame:
    """df with the place of each row in one order over all rows, nulls last, found without bringing them together, however many share a value."""
    placed = running(df, [], _order(F.col(by), larger, tie), sums={name: F.lit(1)}, inclusive=True)
    return placed.withColumn(name, F.col(name).cast("int"))


def all_scores(vectors: DataFrame, query: list[float], key: str = "vec_id") -> DataFrame:
    """Both scores and both ranks of every row, from one projection."""
    spark = vectors.sparkSession
    q = spark.createDataFrame([([float(x) for x in query],)], "q array<double>")
    both = vectors.crossJoin(F.broadcast(q)).select(F.col(key), *(f(F.col("embedding"), F.col("q")).alias(m) for m, (_, f, _) in METHODS.items()))
    for m, (_, _, larger) in METHODS.items():
        both = ranked(both, m, larger, key, f"rank_{m}")
    return both


def indexed_search(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", index: GraphIndex | None = None) -> DataFrame:
    """Distance-ordered search of a collection: rank, key, distance (1 - cosine). By its stored index if one is given, else exact."""
    check_top_k(k)
    if index is not None:
        one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, q array<double>")
        top = index.search(one, k)
    else:
        top = search(vectors, query, k, "cosine", key)
    return top.select("rank", key, (1 - F.col("score")).alias("distance"))


def compare_pair(vectors: DataFrame, a, b, key: str = "vec_id") -> DataFrame:
    """Dot product, norms and scores of two stored vectors; an unknown id is an error."""
    one = vectors.filter(F.col(key) == a).select(F.col(key).alias("a"), F.col("embedding").alias("x"))
    two = vectors.filter(F.col(key) == b).select(F.col(key).alias("b"), F.col("embedding").alias("y"))
    if one.isEmpty() or two.isEmpty():
        raise RetrievalError(f"no vector with id {a if one.isEmpty() else b}")
    x, y = F.col("x"), F.col("y")
    return one.crossJoin(F.broadcast(two)).select("a", "b", V.dot(x, y).alias("dot"), V.norm(x).alias("norm_a"), V.norm(y).alias("norm_b"), V.cosine_similarity(x, y).alias("cosine"), V.euclidean_distance(x, y).alias("euclidean"))


def knn_graph(vectors: DataFrame, k: int = 3, key: str = "vec_id", approximate: bool = False) -> DataFrame:
    """Undirected edges (src < dst) between each vector and its k nearest others by cosine.

    Exact as a report on a stored collection, as every vector is compared with every other, in blocks of bounded size. For large
    collections take `approximate`: neighbour descent, which compares neighbours of neighbours only, as long as that is less work.
    """
    if approximate:
        near = neighbours.nearest(vectors, k, key)
    else:
        near = search_all(vectors, k + 1, "cosine", key).filter(F.col(key) != F.col("query_id"))
        w = Window.partitionBy("query_id").orderBy("rank")
        near = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    return near.select(F.least("query_id", key).alias("src"), F.greatest("query_id", key).alias("dst")).distinct()


def project_2d(vectors: DataFrame, key: str = "vec_id") -> tuple[DataFrame, float]:
    """Centred projection on the first two principal components (x, y; signs arbitrary), and the share of variance kept, in percent."""
    df = vectors.select(F.col(key), array_to_vector("embedding").alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(df)
    flat = model.transform(df).select(key, vector_to_array("p").alias("p"))
    mean = flat.agg(F.avg(F.col("p")[0]).alias("mx"), F.avg(F.col("p")[1]).alias("my"))
    points = flat.crossJoin(F.broadcast(mean)).select(key, (F.col("p")[0] - F.col("mx")).alias("x"), (F.col("p")[1] - F.col("my")).alias("y"))
    return points, 100 * float(sum(model.explainedVariance))


def colour(points: DataFrame, by: str, palette: int = 6) -> DataFrame:
    """Number of each row's colour: the rank of its source among the distinct ones, modulo the palette."""
    names = points.select(by).distinct().withColumn("colour", (F.dense_rank().over(Window.orderBy(by)) - 1) % palette)
    return points.join(names, by)


def norm_range(vectors: DataFrame) -> DataFrame:
    n = V.norm(F.col("embedding"))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"))


def dimensions(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
