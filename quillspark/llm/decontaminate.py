"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every word trigram of the test items is a seed. A first step counts in how many different contexts (CONTEXT
words on both sides) each seed stands, without looking at items, so what it emits has a bound whatever items share; copies of a
document, or a leak that is itself frequent, count once. A seed is rare if it has at most `rare_share` of the
documents' number of contexts, or `rare_least` of them at any size. Seeds that are neither rare nor in at most SHARED items say nothing of an
item and are passed over, but for items that have no other seeds, which use all of theirs.
A second one aligns, for each document and item, windows of words around the seeds that hold a rare one or STRONG
different ones, or are of an item with common seeds alone or one of so few words that one seed reaches the threshold. So a phrase that all documents and items share makes no window.
A document is contaminated by an item when the best local alignment of words (match 2, mismatch -1, gap -1)
reaches `threshold` of what the whole item would score against itself.

Items of fewer than three words have no seeds; they are found where their words stand in that order, whole, with a score
of 1. Items without words take no part; items of the same words are looked for once. Test items are taken to the tasks in blocks of at most `block_items`
items, one pass over the corpus for each block, so what a task holds has a bound whatever the number of items. That pass writes
the pieces of documents that lie as near to a seed as an item can reach, as word hashes; all else works on these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, tidy, words_of

N = 3
BLOCK_ITEMS = 20_000
RARE_SHARE, RARE_LEAST = 0.002, 20
THRESHOLD = 0.5
STRONG = 3
#: Words on each side of a seed that tell its contexts apart; items that may share a common seed that still counts.
CONTEXT, SHARED = 4, 16
MATCH, MISMATCH, GAP = 2, -1, -1
NEAR = pa.schema([("doc_row", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int32()), ("start", pa.int32()), ("words", pa.binary())])
FOUND = pa.schema([("doc_row", pa.int64()), ("doc_id", pa.int64()), ("item_no", pa.int32()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ngrams(h: np.ndarray) -> np.ndarray:
    """Hashes of the word trigrams of an array of word hashes."""
    if len(h) < N:
        return np.empty(0, np.uint64)
    g = h[:-2] * _MIX[0] ^ (h[1:-1] * _MIX[1] + (h[1:-1] >> np.uint64(29))) ^ (h[2:] * _MIX[2] + (h[2:] >> np.uint64(31)))
    return (g ^ (g >> np.uint64(32))) * _MIX[0]


class Seeds:
    """Sorted seed hashes, the items and offsets of each, and a bit map that refuses most other trigrams at once."""

    def __init__(self, items: list[np.ndarray]):
        grams = [ngrams(x) for x in items]
        self.items, self.lengths = items, np.array([len(x) for x in items], np.int64)
        self.short = [(k, x) for k, x in enumerate(items) if len(x) < N]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        self.hashes, number = np.unique(flat, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.item, self.at = item[order], at[order]
        self.first = np.searchsorted(number[order], np.arange(len(self.hashes) + 1))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        # From a seed's place to both ends of the widest window that it can be in, and beyond its context.
        far = np.zeros(len(self.hashes), np.int64)
        np.maximum.at(far, number[order], self.lengths[self.item] + self.lengths[self.item] // 4)
        self.reach = far + 2 * CONTEXT + N + 4
        self.mix = np.cumprod(np.full(2 * CONTEXT + N, _MIX[0] | np.uint64(1), np.uint64), dtype=np.uint64)

    def pieces(self, h: np.ndarray):
        """(start, end) of the stretches of a document that hold all windows and contexts of its seeds."""
        pos, no = self.places(ngrams(h))
        if not len(pos):
            return
        lo = np.maximum(0, pos - self.reach[no])
        hi = np.minimum(len(h), pos + self.reach[no])
        order = np.argsort(lo, kind="stable")
        lo, top = lo[order], np.maximum.accumulate(hi[order])
        cuts = np.flatnonzero(lo[1:] > top[:-1]) + 1
        yield from zip(lo[np.append(0, cuts)].tolist(), top[np.append(cuts - 1, len(top) - 1)].tolist())

    def contexts(self, h: np.ndarray):
        """(seed number, hash of the words around it) of each place of a seed."""
        pos, no = self.places(ngrams(h))
        padded = np.concatenate([np.zeros(CONTEXT, np.uint64), h, np.zeros(CONTEXT, np.uint64)])
        return no, (padded[pos[:, None] + np.arange(2 * CONTEXT + N)] * self.mix).sum(axis=1, dtype=np.uint64)

    def choose(self, common: np.ndarray, threshold: float) -> None:
        """Keep what may tell of an item, given the numbers of the seeds that are not rare. Of items so short that one seed
        reaches the threshold, every seed tells."""
        self.rare = np.ones(len(self.hashes), bool)
        self.rare[common] = False
        times = np.diff(self.first)
        seed = np.repeat(np.arange(len(self.hashes)), times)
        brief = threshold * self.lengths <= N
        telling = (self.rare | (times <= SHARED))[seed] | brief[self.item]
        own = np.bincount(self.item[self.rare[seed]], minlength=len(self.items)) > 0
        #: Items of which every seed is enough: those with common seeds alone, and brief ones.
        self.plain = ~own | brief
        keep = telling | (np.bincount(self.item[telling], minlength=len(self.items)) == 0)[self.item]
        left = np.flatnonzero(np.bincount(seed[keep], minlength=len(self.hashes)))
        self.item, self.at, self.hashes, self.rare = self.item[keep], self.at[keep], self.hashes[left], self.rare[left]
        self.first = np.searchsorted(seed[keep], np.append(left, seed[-1] + 1 if len(seed) else 0))
        self.bits[:] = False
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, g: np.ndarray):
        """(position, seed number) of each seed among the trigrams."""
        pos = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
        if not len(pos) or not len(self.hashes):
            return pos[:0], pos[:0]
        no = np.minimum(np.searchsorted(self.hashes, g[pos]), len(self.hashes) - 1)
        hit = self.hashes[no] == g[pos]
        return pos[hit], no[hit]

    def windows(self, h: np.ndarray):
        """(item, start, window) for each run of hits of an item whose windows overlap, and which choose() lets tell of it."""
        pos, no = self.places(ngrams(h))
        if not len(pos):
            return
        times = self.first[no + 1] - self.first[no]
        entry = np.repeat(self.first[no] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        p, s, item = np.repeat(pos, times), np.repeat(no, times), self.item[entry]
        slack = self.lengths[item] // 4 + 4
        lo = np.maximum(0, p - self.at[entry] - slack)
        hi = np.minimum(len(h), p - self.at[entry] + self.lengths[item] + slack)
        order = np.lexsort((lo, item))
        item, lo, hi, s = item[order], lo[order], hi[order], s[order]
        i = 0
        while i < len(item):
            j, end = i + 1, hi[i]
            while j < len(item) and item[j] == item[i] and lo[j] <= end:
                end = max(end, hi[j])
                j += 1
            # A phrase that repeats makes a long run. An alignment with a score above zero spans at most
            # three times the item's words, so pieces that overlap by as much lose none, and keep memory bounded.
            found, n = np.unique(s[i:j]), int(self.lengths[item[i]])
            if len(found) >= STRONG or self.rare[found].any() or self.plain[item[i]]:
                for at in range(lo[i], max(lo[i] + 1, end - 3 * n), 5 * n):
                    yield int(item[i]), int(at), h[at : min(end, at + 8 * n)]
            i = j

    def whole(self, h: np.ndarray):
        """(item, start) of the first place of each item of fewer than N words."""
        for no, words in self.short:
            hit = h[: len(h) - len(words) + 1] == words[0]
            if len(words) == 2 and len(h) > 1:
                hit &= h[1:] == words[1]
            if len(h) >= len(words) and hit.any():
                yield no, int(hit.argmax())


def align(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """Best local alignment of the item with each window: (score, start, end) in the window, end exclusive."""
    width = max(map(len, windows))
    text = np.zeros((len(windows), width), np.uint64)
    there = np.zeros((len(windows), width), bool)
    for k, w in enumerate(windows):
        text[k, : len(w)], there[k, : len(w)] = w, True
    rows, step = np.arange(len(windows)), -GAP * np.arange(width)
    above = np.zeros((len(windows), width + 1), np.int64)
    begin = np.tile(np.arange(width + 1), (len(windows), 1))
    best, where = np.zeros(len(windows), np.int64), np.zeros((len(windows), 2), np.int64)
    for word in item:
        diagonal = above[:, :-1] + np.where((text == word) & there, MATCH, MISMATCH)
        up = above[:, 1:] + GAP
        cell = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(cell == 0, np.arange(width) + 1, np.where(diagonal >= up, begin[:, :-1], begin[:, 1:]))
        run = cell + step
        top = np.maximum.accumulate(run, axis=1)
        source = np.maximum.accumulate(np.where(run == top, np.arange(width), 0), axis=1)
        cell = top - step
        origin = np.take_along_axis(origin, source, axis=1)
        above = np.concatenate([np.zeros((len(windows), 1), np.int64), cell], axis=1)
        begin = np.concatenate([np.zeros((len(windows), 1), np.int64), origin], axis=1)
        col = cell.argmax(axis=1)
        better = cell[rows, col] > best
        best = np.where(better, cell[rows, col], best)
        where[better] = np.stack([origin[rows, col], col + 1], axis=1)[better]
    return [(float(b), int(s), int(e)) for b, (s, e) in zip(best, where, strict=True)]


def _near(docs: DataFrame, shared) -> DataFrame:
    """(doc_row, doc_id, item, start, words): pieces of documents near seeds (item -1), and places of items without seeds."""

    def run(batches):
        seeds, memo, items = Seeds(shared.value), WordHashes(), shared.value
        for b in batches:
            rows: list[tuple] = []
            for row, doc, text in zip(*(b.column(i) for i in range(3)), strict=True):
                h, key = memo.array(words_of(text.as_py())), (row.as_py(), doc.as_py())
                rows += [(*key, item, start, None) for item, start in seeds.whole(h)]
                rows += [(*key, -1, lo, h[lo:hi].tobytes()) for lo, hi in seeds.pieces(h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(NEAR), NEAR, strict=True)], schema=NEAR)

    return cut(docs.mapInArrow(tidy(run), "doc_row long, doc_id long, item int, start int, words binary"))


def _common(near: DataFrame, shared, most: int) -> np.ndarray:
    """Numbers of the seeds that stand in more than `most` different contexts: no more than there are seeds in the block."""

    def run(batches):
        seeds = Seeds(shared.value)
        for b in batches:
            found = [seeds.contexts(np.frombuffer(w.as_py(), np.uint64)) for w in b.column(0)]
            no, context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))
            pairs = np.unique(np.stack([no.astype(np.int64), context.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1])], names=["seed", "context"])

    places = near.filter("item = -1").select("words").mapInArrow(tidy(run), "seed int, context long")
    often = places.distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return np.array([r["seed"] for r in often.select("seed").collect()], np.int64)


def _aligned(near: DataFrame, shared, common: np.ndarray, threshold: float, batch: int = 256, most_words: int = 1_000_000) -> DataFrame:
    """(doc_row, doc_id, item_no, score, start, end) of each window that aligns well enough, and of each short item."""
    told = near.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seeds, items = Seeds(shared.value), shared.value
        seeds.choose(told.value, threshold)
        out: list[tuple] = []
        waiting: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}  # places of each different item and window
        held = 0

        def settle() -> None:
            rows = sorted(waiting, key=lambda r: (r[0], len(r[1])))
            i = 0
            while i < len(rows):
                j, item = i + 1, items[rows[i][0]]
                while j < len(rows) and rows[j][0] == rows[i][0] and j - i < batch and (j - i) * len(rows[j][1]) < 4_000_000:
                    j += 1
                got = align(item, [np.frombuffer(w, np.uint64) for _, w in rows[i:j]])
                for key, (score, s, e) in zip(rows[i:j], got, strict=True):
                    if score >= threshold * MATCH * len(item):
                        out.extend((row, doc, key[0], score / (MATCH * len(item)), start + s, start + e) for row, doc, start in waiting[key])
                i = j
            waiting.clear()

        def ready() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(FOUND), FOUND, strict=True)], schema=FOUND)
            out.clear()
            return made

        for b in batches:
            for row, doc, item, at, words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if words is None:
                    out.append((row, doc, item, 1.0, at, at + len(items[item])))
                    continue
                for no, start, window in seeds.windows(np.frombuffer(words, np.uint64)):
                    places = waiting.setdefault((no, window.tobytes()), [])
                    held += 1 if places else 1 + len(window)
                    places.append((row, doc, at + start))
                if held > most_words:
                    settle()
                    held = 0
                    yield ready()
        settle()
        yield ready()

    return near.mapInArrow(tidy(run), "doc_row long, doc_id long, item_no int, score double, start int, end int")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare_share: float = RARE_SHARE, rare_least: int = RARE_LEAST, block_items: int = BLOCK_ITEMS, row: str = "doc_id") -> DataFrame:
    """(doc_row, doc_id, item_id, score, start, end): document rows that hold a test item, best place of each pair.

    `row` names the column of docs, a whole number, that tells rows apart; it is returned as doc_row. score is 0 to 1;
    start and end are word positions in the document, end exclusive. Null or empty texts hold nothing; a null item_id
    keeps its hits; items that repeat are reported each. An empty table of either kind gives no rows.
    """
    docs = docs.select(F.col(f"`{row}`").cast("long").alias("doc_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n_items, n_docs, spark = items.count(), docs.count(), docs.sparkSession
    blocks, out = max(1, -(-n_items // block_items)), None
    most = max(rare_least, int(rare_share * n_docs))
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        ids: dict[tuple[bytes, ...], list[int | None]] = {}
        for i, t in own.collect():
            if w := words_of(t):
                ids.setdefault(tuple(w), []).append(i)
        hashes = WordHashes()
        shared = spark.sparkContext.broadcast([hashes.array(list(w)) for w in ids])
        numbers = spark.createDataFrame([(k, i) for k, own_ids in enumerate(ids.values()) for i in own_ids], "item_no int, item_id long")
        near = _near(docs, shared)
        found = _aligned(near, shared, _common(near, shared, most), threshold).join(F.broadcast(numbers), "item_no")
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_row", "doc_id", "item_id").agg(F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"))).alias("best"))
    return best.select("doc_row", "doc_id", "item_id", "best.score", "best.start", "best.end")
