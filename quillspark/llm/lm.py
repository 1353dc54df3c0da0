"""Stupid-backoff scores by count tables that are partitioned by hash.

Corpus counts c of word 1- to 3-grams cover all documents; n-grams of order 2 and 3 that occur once are pruned. A word
w after (u, v) scores c(uvw)/c(uv) if uvw is in the tables, else alpha c(vw)/c(v) if vw is, else alpha^2 c(w)/N.
A document's second word starts at the second form (without alpha), its first word at c(w)/N.

Relational plan: documents are taken in batches of some MB. A batch explodes into its distinct n-grams with their
counts (the pre-aggregation: a word that is in every document is one row for each batch, so there is no hot key), cut
into runs by the top bits of the hash. Runs of one hash range meet in one task, which sums them to its part of the
count table and joins each run with it; the runs go back to their batch, which sums logarithms for each document.
The number of hash ranges grows with the corpus, so a range keeps its size. Runs travel as byte planes, compressed,
several times smaller than rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, in_pieces, tidy, words_of

ALPHA, PRUNE, RANGE_WORDS, BATCH_CHARS = 0.4, 2, 2_500_000, 10_000_000
#: Bits of an n-gram's hash. Two of 10^13 n-grams share one with a chance of some 10^-4 for each.
HASH_BITS = 56
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of an array, planes apart, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def expand(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - HASH_BITS)


def grams(h: np.ndarray, first: np.ndarray):
    """Hashes of the 1-, 2- and 3-grams that end at each word; first: word numbers at which documents start."""
    one = _mixed(h * _A + np.uint64(1))
    before = np.concatenate([[np.uint64(0)], h[:-1]])
    two = _mixed(_mixed(before * _B + np.uint64(2)) + h * _A)
    earlier = np.concatenate([[np.uint64(0)] * min(2, len(h)), h[:-2]])
    three = _mixed(_mixed(_mixed(earlier * _C + np.uint64(3)) + before * _B) + h * _A)
    order = np.full(len(h), 3, np.int8)
    first = first[first < len(h)]
    second = first + 1
    order[second[second < len(h)]] = 2
    order[first] = 1
    return one, two, three, order


def _batches(docs: DataFrame, batch_chars: int) -> DataFrame:
    def run(batches):
        part, seq, memo = TaskContext.get().partitionId(), 0, WordHashes()
        for b in in_pieces(batches, batch_chars):
            words = [memo.array(words_of(t)) for t in b.column(1).to_pylist()]
            sink = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([b.column(0)], names=["doc_id"])
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            # Words as numbers in the batch's own vocabulary, the most frequent first: small numbers compress well.
            vocabulary, number, often = np.unique(np.concatenate(words) if words else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            vocabulary, number = vocabulary[order], place[number]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.array([sink.getvalue().to_pybytes()]), pa.array([squeeze(np.array([len(w) for w in words], np.int64))]), pa.array([squeeze(vocabulary)]), pa.array([squeeze(number.astype(np.uint32))]), pa.array([len(number)])],
                names=["batch", "ids", "lengths", "vocabulary", "number", "n"],
            )
            seq += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "batch long, ids binary, lengths binary, vocabulary binary, number binary, n long")


def _open(vocabulary: bytes, number: bytes, lengths: bytes):
    """The batch's words, document lengths and n-grams."""
    lengths = expand(lengths, "i8")
    h = expand(vocabulary, "u8")[expand(number, "u4")]
    first = np.cumsum(lengths) - lengths
    return lengths, first[lengths > 0], *grams(h, first[lengths > 0])


def _flat(one, two, three, order) -> np.ndarray:
    """All n-grams of a batch: those of order 1, then 2, then 3."""
    return np.concatenate([one, two[order >= 2], three[order >= 3]])


def _distinct(one, two, three, order):
    """Distinct n-grams of a batch, sorted by hash, with their counts."""
    return np.unique(_flat(one, two, three, order), return_counts=True)


def score(docs: DataFrame, alpha: float = ALPHA, prune: int = PRUNE, batch_chars: int = BATCH_CHARS, range_words: int = RANGE_WORDS) -> DataFrame:
    """(doc_id, n_words, log_score): natural logarithm of the product of a document's word scores.

    Words are runs of letters and digits, A-Z lower-cased. A null text or one without words has n_words 0 and
    log_score 0. Null ids keep their row; repeated rows count and are scored each. No rows give no rows.
    """
    batches = cut(_batches(docs, batch_chars))
    total = batches.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / range_words))))

    def ask(rows):
        for b in rows:
            for batch, lengths, vocabulary, number in zip(*(b.column(c).to_pylist() for c in ("batch", "lengths", "vocabulary", "number")), strict=True):
                _, _, one, two, three, order = _open(vocabulary, number, lengths)
                h, n = _distinct(one, two, three, order)
                edges = np.searchsorted(h >> np.uint64(HASH_BITS - bits) if bits else np.zeros(len(h), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
                own, hashes, counts = [], [], []
                for r in range(1 << bits):
                    part = h[edges[r] : edges[r + 1]]
                    if len(part):
                        own.append(r)
                        hashes.append(squeeze(np.concatenate([part[:1], np.diff(part)])))
                        counts.append(squeeze(n[edges[r] : edges[r + 1]].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([batch] * len(own), pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["range", "batch", "hashes", "counts"])

    asked = batches.select("batch", "lengths", "vocabulary", "number").mapInArrow(tidy(ask), "range int, batch long, hashes binary, counts binary")

    def answer(rows):
        runs = [np.cumsum(expand(x.as_py(), "u8"), dtype=np.uint64) for x in rows["hashes"]]
        keys, at = np.unique(np.concatenate(runs), return_inverse=True)
        # Exact up to 2^53 occurrences.
        sums = np.bincount(at, weights=np.concatenate([expand(x.as_py(), "u4") for x in rows["counts"]]), minlength=len(keys)).astype(np.uint64)
        cuts = np.cumsum([0] + [len(r) for r in runs])
        back = [squeeze(sums[at[cuts[i] : cuts[i + 1]]]) for i in range(len(runs))]
        return pa.table({"range": rows["range"], "batch": rows["batch"], "counts": pa.array(back, pa.binary())})

    answers = asked.groupBy("range").applyInArrow(answer, "range int, batch long, counts binary")

    def finish(left, right):
        out = []
        for ids, lengths, vocabulary, number in zip(*(left[c].to_pylist() for c in ("ids", "lengths", "vocabulary", "number")), strict=True):
            lengths, first, one, two, three, order = _open(vocabulary, number, lengths)
            sums = np.zeros(len(lengths))
            if len(one):
                _, at = np.unique(_flat(one, two, three, order), return_inverse=True)
                runs = right.sort_by("range")["counts"].to_pylist()
                seen = np.concatenate([expand(x, "u8") for x in runs]).astype(np.float64)[at]
                c1, c2, c3 = seen[: len(one)], np.zeros(len(one)), np.zeros(len(one))
                pairs = int((order >= 2).sum())
                c2[order >= 2], c3[order >= 3] = seen[len(one) : len(one) + pairs], seen[len(one) + pairs :]
                c1_before, c2_before = np.concatenate([[1], c1[:-1]]), np.concatenate([[1], c2[:-1]])
                with np.errstate(divide="ignore", invalid="ignore"):
                    level2 = np.where(c2 >= prune, c2 / c1_before, alpha * c1 / total)
                    level3 = np.where(c3 >= prune, c3 / c2_before, alpha * level2)
                p = np.select([order == 1, order == 2], [c1 / total, level2], level3)
                sums[lengths > 0] = np.add.reduceat(np.log(p), first)
            ids = pa.ipc.open_stream(ids).read_all()["doc_id"].combine_chunks()
            out.append(pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums)], schema=SCORES))
        return pa.Table.from_batches(out, SCORES)

    return batches.drop("n").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, "doc_id long, n_words long, log_score double")
