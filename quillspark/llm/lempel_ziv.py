"""Document fingerprints by Lempel-Ziv phrases. A text is parsed from left to right into phrases, each the shortest piece that
is no phrase yet; the set of phrases, hashed, is kept as its SIGNS smallest hashes. The share of equal ones among the smallest of
two sets together estimates how many phrases two texts share, which is what a compressor would save on one after the other.

A fingerprint is a text of 12 hexadecimal digits for each hash, ascending; equal texts have equal ones, and that of an empty text is empty.
Up to SIGNS phrases the likeness is exact.

with_edited() also fingerprints each text as it reads when its last quarter is replaced by the beginning of the next document.
The parse up to the edit is the same, so it is resumed there, not repeated. Documents meet their next one in ranges of ids
that are sorted and streamed; the first document of a range goes to the range before too. Texts are shuffled once.

Defined results: a null text is empty and shares no phrase with others, but is like another empty one (likeness 1); rows that share a
doc_id follow each other by the hash of their text and then the text; a null id comes first; a single document is its own next;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_pieces, tidy

SIGNS, DIGITS = 128, 12
#: Characters of a range of ids, and the most ranges: what a task sorts and streams.
RANGE_CHARS, MOST_RANGES = 2_000_000, 10_000
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers = np.array([1], np.uint64)


def parse(text: str, start: int, seen: set[str]) -> list[int]:
    """Ends of the phrases of a text from `start` on, which are added to `seen`. What is left at the end is no new phrase."""
    ends, at, piece = [], start, ""
    end, add = ends.append, seen.add
    for sign in text[start:] if start else text:
        at += 1
        piece += sign
        if piece not in seen:
            add(piece)
            end(at)
            piece = ""
    return ends


def hashes(text: str, ends: list[int], start: int = 0) -> np.ndarray:
    """64-bit hashes of the pieces of a text between `start` and the ends, each by its own code points."""
    global _powers
    if not ends:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.array(ends, np.int64) - start
    first = np.empty_like(stops)
    first[0], first[1:] = 0, stops[:-1]
    sizes = stops - first
    most = int(sizes.max())
    if most > len(_powers):
        _powers = np.cumprod(np.append(np.uint64(1), np.full(2 * most, _BASE, np.uint64)), dtype=np.uint64)
    h = np.add.reduceat((codes + np.uint64(1)) * _powers[np.arange(len(codes)) - np.repeat(first, sizes)], first)
    for shift, factor in zip((30, 27), _MIX, strict=True):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def smallest(h: np.ndarray) -> np.ndarray:
    """The SIGNS smallest different hashes, cut to the digits that a fingerprint shows, ascending."""
    h = np.sort(h >> np.uint64(64 - 4 * DIGITS))
    return h[np.append(True, h[1:] != h[:-1])][:SIGNS] if len(h) else h


def shown(signs: np.ndarray) -> str:
    return signs.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smallest hashes of two sets together that both have; 1 for two empty sets."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    again = both[1:] == both[:-1]
    # What both have stands there twice; the place of a hash among the different ones.
    place = np.arange(1, len(both)) - np.cumsum(again)
    n = min(SIGNS, len(both) - int(again.sum()))
    return float((again & (place < n)).sum()) / n


def likeness(a: Column, b: Column) -> Column:
    """alike() of two fingerprints as a Column, for pairs that a caller has joined; null where one is null."""
    signs = lambda f: F.regexp_extract_all(f, F.lit(f".{{{DIGITS}}}"), F.lit(0))
    both = F.slice(F.array_sort(F.array_union(signs(a), signs(b))), F.lit(1), F.lit(SIGNS))
    share = F.size(F.array_intersect(both, F.array_intersect(signs(a), signs(b)))) / F.size(both)
    return F.when(a.isNotNull() & b.isNotNull(), F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(share))


def fingerprint(text: str) -> str:
    return shown(smallest(hashes(text, parse(text, 0, set()))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each document. Narrow: no shuffle."""

    def run(batches):
        for b in in_pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or "") for t in b.column(1).to_pylist()], pa.string())], names=[key, "fingerprint"])

    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


class _Parsed:
    """A document with its phrases, from which an edit's are found."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.seen = doc_id, text, set()
        self.ends = parse(text, 0, self.seen)
        self.hashes = hashes(text, self.ends)
        self.signs = smallest(self.hashes)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by as many characters of another, and its smallest hashes; once for each document."""
        keep = len(self.text) - len(self.text) // 4
        text = self.text[:keep] + following[: len(self.text) // 4]
        # Phrases that end before the edit stay, later ones go.
        k = bisect_right(self.ends, keep)
        at = self.ends[k - 1] if k else 0
        self.seen.difference_update(self.text[a:b] for a, b in zip([at, *self.ends[k:]], self.ends[k:]))
        return text, smallest(np.concatenate([self.hashes[:k], hashes(text, parse(text, at, self.seen), at)]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _stream(batches):
    """Rows (range, follows, doc_id, text) in order to results: each document with the one after it in its range.

    The first document of the next range comes last in a range, as a row that follows only.
    """
    last: tuple[int, _Parsed] | None = None
    for b in in_pieces(pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(x.columns[:3], names=["r", "f", "d"]), x.column(3)], names=["k", "t"]) for x in batches):
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            now = _Parsed(key["d"], text.as_py() or "")
            if last and last[0] == key["r"]:
                doc = last[1]
                text, signs = doc.edited(now.text)
                rows.append((doc.doc_id, len(doc.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), shown(doc.signs), shown(signs), alike(doc.signs, signs), alike(doc.signs, now.signs)))
            last = (key["r"], now) if not key["f"] else None
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)


def with_edited(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = int(min(MOST_RANGES, chars // range_chars + 1))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = np.array(sorted(set(rows.approxQuantile("doc_id", steps, 0.25 / ranges)) if steps else []), float)

    @F.pandas_udf("int")
    def place(ids):
        return ids.fillna(float("-inf")).pipe(lambda x: x.__class__(np.searchsorted(bounds, x.to_numpy(float), side="right").astype(np.int32)))

    # Ids beyond 2^53 are rounded for the bounds alone: equal ids and their order stay together.
    rows = rows.withColumn("range", place(F.col("doc_id").cast("double")) if len(bounds) else F.lit(0)).withColumn("h", F.xxhash64("text"))
    # A row for each range: the first document of each, which the range before needs as well; that of the first goes to the last.
    firsts = cut(rows.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first")))
    known = firsts.orderBy("range").collect()
    ring = [(r["range"], known[i - 1]["range"], r["first"]["doc_id"], r["first"]["h"]) for i, r in enumerate(known)]
    before = docs.sparkSession.createDataFrame(ring, "range int, earlier int, d long, x long")
    marked = rows.join(F.broadcast(before), "range", "left")
    first = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x"))
    places = F.array_compact(F.array(F.struct("range", F.lit(0).alias("follows")), F.when(first, F.struct(F.col("earlier").alias("range"), F.lit(1).alias("follows")))))
    dealt = marked.select(F.explode(places).alias("p"), "doc_id", "h", "text").select("p.range", "p.follows", "doc_id", "h", "text")
    ordered = dealt.repartition(ranges, "range").sortWithinPartitions("range", "follows", F.asc_nulls_first("doc_id"), "h", "text")
    out = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'string'}" for f in _OUT)
    return ordered.select("range", "follows", "doc_id", "text").mapInArrow(tidy(_stream), out)
