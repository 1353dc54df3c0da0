"""A graph of nearest vectors without comparing all pairs: neighbour descent.

Each vector keeps its WIDTH best neighbours so far, first those in random groups of bounded size. Then, round by round, the neighbours of a
vector, and a bounded number of those that have it as theirs, are compared with each other, as neighbours of one vector are likely to be
each other's; pairs that were compared before are not compared again. Rounds go through checkpoints and end when few
neighbours change. A round's work is rows x WIDTH^2, whatever the number of rows.

How many neighbours are enough depends on the vectors: the more of them, and the fewer clusters they have, the more it takes. So the result is
measured: some vectors are compared with all others, and where too few of their nearest ones were found, rounds go on with twice the width.
Rounds of a great width are more work than comparing all pairs, and hold more in the driver, as they are many jobs. Where that is so, all pairs
are compared, and nothing is left out.

Equal vectors are one point, so copies of a vector, however many, cost no more than one; they get each other as neighbours at the
end, in the order of their ids. Vectors that are null, zero or not finite have no cosine and no neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut, tidy

#: Neighbours kept, rows of a first group, dealings into such groups, most rounds, and the share of neighbours that may still change at the end.
WIDTH, GROUP, DEALS, ROUNDS, STILL = 32, 32, 4, 14, 0.002
#: Comparisons of all pairs that take as long as all rounds of a width, for each vector, in squares of twice the width: measured on 51,282 vectors,
#: where rounds of width 64 took 172 s and all pairs 27 s.
COST = 20
#: Vectors for which a result is measured, the share of their nearest ones that has to be found, and rows of a block of products.
ASKED, WANTED, BLOCK = 500, 0.98, 1024
_PAIRS = pa.schema([("id", pa.int64()), ("nbr", pa.int64()), ("score", pa.float64())])


def _units(v: pa.Array, size: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of vectors and their sizes."""
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) / size.to_numpy(zero_copy_only=False)[:, None]


def _sized(points: DataFrame) -> DataFrame:
    """(id, v, size); vectors without a size are unit vectors."""
    return points.select("id", "v", "size" if "size" in points.columns else F.lit(1.0).alias("size"))


def _grouped(batches):
    """(member, new, least, unit vectors) of each run of rows (center, member, new, least, v, size) with one center, sorted by it."""
    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        v = _units(batch.column(4), batch.column(5))
        at = [0, *(np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:]):
            piece = [c[lo:hi] for c in (*columns, v)]
            if rest and rest[0][0] == piece[0][0]:
                rest = [np.concatenate(x) for x in zip(rest, piece, strict=True)]
            else:
                if rest:
                    yield rest[1:]
                rest = piece
    if rest:
        yield rest[1:]


def _compared(batches):
    """Pairs of each group of which one is new and that are better than the worst neighbour of the one they are for."""
    out: list[tuple] = []
    held = 0
    for member, new, least, v in _grouped(batches):
        for lo in range(0, len(v), BLOCK):
            some = slice(lo, lo + BLOCK)
            score = v[some] @ v.T
            wanted = (new[some, None] | new) & (member[some, None] != member) & (score > least[some, None])
            a, b = np.nonzero(wanted)
            out.append((member[some][a], member[b], score[a, b]))
            held += len(a)
            if held > 200_000:
                yield _pairs(out)
                out, held = [], 0
    yield _pairs(out)


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)


def _best(pairs: DataFrame, width: int) -> DataFrame:
    """The best neighbours of each id among (id, nbr, score, new); one that was there before is not new."""
    one = pairs.groupBy("id", "nbr").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "nbr")
    return one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= width)


def descend(points: DataFrame, width: int = WIDTH, group: int = GROUP, rounds: int = ROUNDS, still: float = STILL, known: DataFrame | None = None) -> DataFrame:
    """(id, nbr, score, n): neighbours of points, from the best. `known`: the result of a smaller width.

    Points are (id, v: a unit vector), or (id, v, size: the length of v); no two have one direction.
    """
    points = cut(_sized(points))
    many = points.count()
    compare = lambda rows: rows.repartition("center").sortWithinPartitions("center").mapInArrow(_compared, "id long, nbr long, score double")
    if known is None:
        # Several dealings into groups, so that their neighbours lie in groups of others.
        groups = -(-many // group) or 1
        place = F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(groups)) * DEALS + i for i in range(DEALS))))
        first = points.select(place.alias("center"), F.col("id").alias("member"), F.lit(True).alias("new"), F.lit(-2.0).alias("least"), "v", "size")
        edges = cut(_best(compare(first).withColumn("new", F.lit(True)), width))
    else:
        # What a smaller width had no place for has to be compared again.
        edges = known.select("id", "nbr", "score", F.lit(True).alias("new"), "n")
    for turn in range(rounds):
        # Who has whom: a bounded number of those that have an id, the nearest ones.
        back = Window.partitionBy("nbr").orderBy(F.desc("score"), "id")
        of = edges.select(F.col("id").alias("center"), F.col("nbr").alias("member"), "new")
        to = edges.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= width).select(F.col("nbr").alias("center"), F.col("id").alias("member"), "new")
        # Where none is new, all have been compared with each other.
        live = F.max("new").over(Window.partitionBy("center"))
        met = of.unionByName(to).withColumn("live", live).filter("live").groupBy("center", "member").agg(F.max("new").alias("new"))
        # An id with fewer than `width` neighbours takes any.
        worst = edges.groupBy("id").agg(F.when(F.count(F.lit(1)) >= width, F.min("score")).otherwise(-2.0).alias("least"))
        full = points.join(worst, "id", "left").select(F.col("id").alias("member"), F.coalesce("least", F.lit(-2.0)).alias("least"), "v", "size")
        found = compare(met.join(full, "member").select("center", "member", "new", "least", "v", "size"))
        edges = cut(_best(edges.select("id", "nbr", "score", F.lit(False).alias("new")).unionByName(found.withColumn("new", F.lit(True))), width))
        tidy(points.sparkSession)
        if edges.filter("new").count() <= still * many * width:
            break
    return edges.select("id", "nbr", "score", "n")


def recall(points: DataFrame, found: DataFrame, k: int, asked: int = ASKED) -> float:
    """The share of the k nearest others of about `asked` points, taken by a hash of their ids, that is among the first k of `found`."""
    points = _sized(points)
    many = points.count()
    if many < 2:
        return 1.0
    picked = F.lit(True) if many <= asked else F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(many)) < asked
    some = points.filter(picked).toArrow()
    ids = some["id"].to_numpy()
    if not len(ids):
        return 1.0
    q = _units(some["v"].combine_chunks(), some["size"].combine_chunks())
    shared = points.sparkSession.sparkContext.broadcast((ids, q))

    def best(batches):
        ids, q = shared.value
        top = np.full((len(ids), k), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v = batch.column(0).to_numpy(), _units(batch.column(1), batch.column(2))
            for lo in range(0, batch.num_rows, BLOCK):
                score = np.where(ids[:, None] == own[lo : lo + BLOCK], -np.inf, q @ v[lo : lo + BLOCK].T)
                top = -np.partition(-np.concatenate([top, score], axis=1), k - 1, axis=1)[:, :k]
        a, b = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(top[a, b], pa.float64())], names=["id", "score"])

    w = Window.partitionBy("id").orderBy(F.desc("score"))
    true = points.mapInArrow(best, "id long, score double").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    # By score, not by id: of equally near ones any will do.
    goal = true.groupBy("id").agg(F.min("score").alias("goal"), F.count(F.lit(1)).alias("of"))
    hits = F.count(F.when(F.col("score") >= F.col("goal") - 1e-9, 1))
    each = goal.join(found.filter(F.col("n") <= k).select("id", "score"), "id", "left").groupBy("id").agg(hits.alias("hits"), F.first("of").alias("of"))
    got = each.agg(F.sum("hits").alias("hits"), F.sum("of").alias("of")).first()
    return got["hits"] / got["of"]


def nearest(vectors: DataFrame, k: int = 3, key: str = "vec_id", wanted: float = WANTED, **options) -> DataFrame:
    """(query_id, rank, key, score): the k nearest others found for each vector, by cosine, ties to the smaller key. Keys are whole numbers.

    The width doubles until the measured recall of points is `wanted`, or until all pairs are less work than the rounds of the next width.
    """
    from .retrieval import search_all

    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    # Single precision, if it is that, is enough to carry: unit vectors are made of it where they are compared.
    carried = F.col("embedding").cast("array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>")
    own = vectors.select(F.col(key).cast("long").alias("id"), carried.alias("x"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    own = own.withColumn("size", size).select("id", "x", "size", F.transform("v", lambda x: x / F.col("size")).alias("v"))
    # Equal directions are one point, named by the smallest id.
    groups = own.groupBy("v").agg(F.min("id").alias("rep"))
    members = cut(own.join(groups, "v").select("rep", "id", "x", "size"))
    points = members.filter("rep = id").select("id", F.col("x").alias("v"), "size").dropDuplicates(["id"])
    width, many = max(options.pop("width", WIDTH), k), points.count()
    found = descend(points, width, **options)
    while width < many - 1 and recall(points, found, k) < wanted:
        width *= 2
        if COST * (2 * width) ** 2 >= many:
            # A point is the nearest to itself.
            whole = search_all(points.select("id", F.col("v").alias("embedding")), k + 1, "cosine", "id").filter("id <> query_id")
            order = Window.partitionBy("query_id").orderBy("rank")
            found = cut(whole.select(F.col("query_id").alias("id"), F.col("id").alias("nbr"), "score", F.row_number().over(order).alias("n")))
            break
        found = descend(points, width, known=found, **options)
    few = Window.partitionBy("rep").orderBy("id")
    firsts = members.select("rep", "id").withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1).drop("n")
    others = found.filter(F.col("n") <= k).select(F.col("id").alias("rep"), F.col("nbr").alias("other"), "score")
    some = others.join(firsts.select(F.col("rep").alias("other"), "id"), "other").select("rep", "id", "score").unionByName(firsts.withColumn("score", F.lit(1.0)))
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    few_best = some.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    lists = few_best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))
    rows = members.select("rep", F.col("id").alias("query_id")).join(lists, "rep")
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), F.lit(1), F.lit(k))
    return rows.select("query_id", F.posexplode(mine).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(key), (-F.col("x.far")).alias("score"))
