"""Whitening of vectors: centred rows are compressed block by block to a triangle R (TSQR), plane rotations make R's columns
orthogonal (one-sided Jacobi), and the rotations together are the components; the columns' lengths give the deviations.

Entries become whole numbers x = floor(scale * c) + shift first, so sums are exact and rows are centred exactly: the numerators
n * x - S are whole, and S / n is never rounded before it is taken away. No table is brought together: tasks pass on one triangle or one set of moments,
and two rounds of merging leave a few of them for the driver, however many rows there are.

Defined results: rows whose vector is null, holds a null or an entry that isn't finite, or has another length than most
(the shorter one where two are equally frequent) take no part; repeated rows count each time; directions without variance are
no component, so fewer than `most` may be left, and none where all rows are equal; an empty table gives an empty result;
other columns are not read. Entries of 2^40 or more are refused with an error, as sums may not fit.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SCALE, SHIFT = 1024, 100_000
#: Tasks of the two rounds of merging.
ROUNDS = (64, 8)
_PIECE_DDL = "part long, n long, mean array<double>, square array<double>"
_PIECE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("square", pa.list_(pa.float64()))])
#: A column is no direction of its own if it is this much shorter than the longest.
_TINY = 1e-12


class Whitening(NamedTuple):
    """n rows with sums S by dimension; components as columns, and their variances, from the largest; the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(key, v): rows with a vector of finite doubles of the most frequent length; and that length, 0 for none."""
    v = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    fine = v.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = fine.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = first["dim"] if first else 0
    return fine.filter(F.size("v") == dim), dim


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if x.size and np.abs(x).max() >= 2.0**40:
        raise ValueError("entries of 2^40 or more can't be whitened")
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums of each dimension. Each task passes on a row for each dimension."""

    def run(batches):
        total, n = np.zeros(dim, np.int64), 0
        for b in batches:
            x = _whole(b.column(1), dim)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total)], names=["dim", "n", "s"])

    rows = vectors.mapInArrow(tidy(run), "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return rows[0]["n"], np.array([r["s"] for r in rows], np.int64)


def _merged(pieces: DataFrame, merge) -> list:
    """One piece from each of a few tasks: rows (part, n, mean, square) merged in rounds, each by a task that keeps one piece."""

    def run(batches):
        got = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = row[1:] if got is None else merge(got, row[1:])
        if got is not None:
            # The next round deals by this number.
            yield _piece(hash(tuple(got[2][:8])) & 0x7FFFFFFF, *got)

    for n in ROUNDS:
        pieces = pieces.repartition(n, "part").mapInArrow(tidy(run), _PIECE_DDL)
    return [tuple(r)[1:] for r in pieces.collect()]


def _piece(part: int, n: int, mean, square) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, n, list(mean), list(square)), _PIECE, strict=True)], schema=_PIECE)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _tsqr(vectors: DataFrame, dim: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows: R'R is n times their covariance matrix."""

    def stacked(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate([r, rows]), mode="r")

    def run(batches):
        r, part = np.zeros((0, dim)), 0
        for b in batches:
            part = part or b.column(0).slice(0, 1).to_pylist()[0] or 0
            for at in range(0, b.num_rows, 4096):
                r = stacked(r, _centred(_whole(b.column(1).slice(at, 4096), dim), n, sums))
        if len(r):
            yield _piece(part & 0x7FFFFFFF, len(r), [], r.ravel())

    def merge(a, b):
        r = stacked(*(np.reshape(x[2], (-1, dim)) for x in (a, b)))
        return len(r), [], r.ravel()

    keyed = vectors.select(F.xxhash64("key").alias("key"), "v")
    r = np.zeros((0, dim))
    for piece in _merged(keyed.mapInArrow(tidy(run), _PIECE_DDL), merge):
        r = stacked(r, np.reshape(piece[2], (-1, dim)))
    return np.concatenate([r, np.zeros((dim - len(r), dim))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, from the largest, and its right singular vectors as columns, by one-sided rotations.

    A round turns dim / 2 pairs of columns at once, none of which share a column; each pair is met once in a sweep.
    """
    dim = r.shape[1]
    a, v = r.astype(float).copy(), np.eye(dim)
    places = list(range(dim + dim % 2))
    half = len(places) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(places) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(places[:half], reversed(places[half:])) if max(p, q) < dim]
            places = [places[0], places[-1], *places[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            due = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not due.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[due], q[due], alpha[due], beta[due], gamma[due]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    size = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


def fit(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = 8) -> Whitening | None:
    """The components of all usable vectors. Each is turned so that its largest entry is positive. None if there are no vectors."""
    rows, dim = usable(vectors, key, column)
    if not dim:
        return None
    n, sums = _sums(rows, dim)
    size, v = jacobi(_tsqr(rows, dim, n, sums))
    e = size * size / n
    keep = [i for i in range(min(most, dim)) if size[i] > _TINY * max(size[0], 1.0)]
    v, signs = v[:, keep], np.sign(v[np.abs(v[:, keep]).argmax(axis=0), keep])
    return Whitening(n, sums, v * signs, e[keep], float(e.sum()))


def _white(model: Whitening, x: np.ndarray) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.components / np.sqrt(model.variances)


def identity_error(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> float:
    """The largest entry, signs aside, of the covariance of the whitened vectors less the identity. Moments are centred within
    each task and merged."""
    rows, dim = usable(vectors, key, column)
    k = len(model.variances)

    def joined(a, b):
        na, nb = a[0], b[0]
        ma, mb = np.array(a[1]), np.array(b[1])
        gap, n = mb - ma, na + nb
        return n, ma + gap * (nb / n), np.array(a[2]) + np.array(b[2]) + (np.outer(gap, gap) * (na * nb / n)).ravel()

    def run(batches):
        got, part = None, 0
        for b in batches:
            part = part or b.column(0).slice(0, 1).to_pylist()[0] or 0
            if b.num_rows:
                w = _white(model, _whole(b.column(1), dim))
                mean = w.mean(axis=0)
                piece = (len(w), mean, ((w - mean).T @ (w - mean)).ravel())
                got = piece if got is None else joined(got, piece)
        if got is not None:
            yield _piece(part & 0x7FFFFFFF, *got)

    keyed = rows.select(F.xxhash64("key").alias("key"), "v")
    got = None
    for piece in _merged(keyed.mapInArrow(tidy(run), _PIECE_DDL), joined):
        got = piece if got is None else joined(got, piece)
    return float(np.abs(np.reshape(got[2], (k, k)) / got[0] - np.eye(k)).max()) if got is not None and k else 0.0


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums over the dimensions of (n x - S)^2 as decimals of 38 digits; null beyond that."""
    gap = n * x - sums
    if not gap.size or float(np.abs(gap).max()) ** 2 * gap.shape[1] < 2.0**62:
        return pa.array((gap * gap).sum(axis=1)).cast(pa.decimal128(38, 0))
    from decimal import Decimal

    exact = [sum(int(g) ** 2 for g in row) for row in gap]
    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    kind = vectors.schema[key].dataType.simpleString()
    if kind != "bigint":
        raise PySparkValueError(f"the key must be a bigint, not {kind}")
    model = fit(vectors, key, column, most)
    ddl = f"`{key}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], ddl)
    rows, dim = usable(vectors, key, column)
    error, k = identity_error(vectors, model, key, column), len(model.variances)
    explained = model.variances / model.total if k else model.variances
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for b in batches:
            x = _whole(b.column(1), dim)
            m, each = len(x), pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), _deviations(x, model.n, model.sums).take(each), pa.array(_white(model, x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=names,
            )

    return rows.mapInArrow(tidy(run), ddl)
