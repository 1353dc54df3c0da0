"""What the operators share: durable cut points, bounded samples, word splitting and word hashes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII: A-Z to a-z, digits and a-z kept, everything else to a blank. Bytes from 0x80 on are kept.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without it a local session gets a folder of its own; a cluster is refused,
    since no machine's own folder is shared there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="quillspark-")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str = "doc_id"):
    """crc32 of the key as text, modulo 4; a null key counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4, F.lit(0))


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int = 0) -> DataFrame:
    """The `rows` rows with the smallest hashes of the key: a repeatable, bounded sample.

    A count first tells which hashes can be among them, so the partitions together pass on little more than `rows`.
    """
    n, h = df.count(), F.xxhash64(F.lit(salt), F.col(key))
    if n > 2 * rows:
        most = int(-(2**63) + min(1.0, (1.2 * rows + 200) / n) * 2.0**64)
        low = df.filter(h <= F.lit(min(most, 2**63 - 1)))
        # Keys that repeat often make hashes uneven; then all rows are sorted.
        df = low if low.count() >= rows else df
    return df.orderBy(h, F.col(key)).limit(rows)


def per_process(key, make):
    """make(), once for each Python process: what tasks that run in the same worker share, such as a loaded file."""
    kept = sys.modules.setdefault("quillspark_process", types.ModuleType("quillspark_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def tidy(run):
    """A function of mapInArrow that gives its memory back to the system when its task ends: workers live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


class WordHashes(dict):
    """xxh64 of a word, remembered; forgets all when it holds `most` words, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of a-z, 0-9 and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def in_pieces(batches, most_chars: int = 4_000_000):
    """Re-cut Arrow batches of (key, text) to pieces of about `most_chars` bytes; a longer text is a piece of its own."""
    for batch in batches:
        texts = batch.column(1)
        start, size = 0, 0
        for i in range(batch.num_rows):
            n = len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if size and size + n > most_chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: The most keys that without() broadcasts: some 10 MB.
MOST_KEYS = 400_000


def without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """docs whose `key` is not among keys. Few keys are broadcast, after counting them; more are joined by a shuffle."""
    keys = cut(keys.select(key).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, key, "left_anti")


def join_copies(rows: DataFrame, facts: DataFrame, key: str, copies: str = "copies", least: int = 10_000) -> DataFrame:
    """rows joined to facts, which has one row for each key and the number of rows that share it.

    Keys with more than `least` rows, and more than a ten thousandth of all, are at most 10,000: their facts are broadcast and their rows
    stay where they are. Only the others are dealt by key, so no key brings many rows into one task.
    """
    facts = cut(facts)
    most = max(least, (facts.agg(F.sum(copies)).first()[0] or 0) // 10_000)
    often = F.broadcast(facts.filter(F.col(copies) > most))
    rest = rows.join(often, key, "left_anti").join(facts.filter(F.col(copies) <= most), key)
    return rows.join(often, key).unionByName(rest)
