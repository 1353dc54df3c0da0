"""Bounded-space online packing of token ids into sequences of `width` tokens.

Each partition keeps at most `windows` open windows. A document's whole-width head pieces are emitted at once; its
tail goes to the open window that it fills best. If it fits in none and no further window may be opened, the fullest
is closed: a gap of at least `fill` tokens is filled with the head of the tail first, a smaller one stays padding.
What is open at a partition's end is merged in groups of `merge` partitions, cutting freely, so a group leaves at
most one sequence that is not full.

Tokenising: byte-level BPE splits never cross a blank followed by a word, so a text whose only white space is single
blanks and line ends is encoded word by word ("blank + word" units, remembered). All other texts go whole to the encoder,
so do texts that hold one of its added tokens, and every text where the file's settings aren't those of plain byte-level BPE.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_process, tidy

WIDTH, WINDOWS, FILL, MERGE = 1024, 32, 8, 64
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
SPARK_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


#: Fixed value: the split pattern of the ByteLevel pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Odd(ValueError):
    """A part that can't be encoded by itself."""


class _Words(dict):
    """Ids of parts, remembered up to `most`: each is encoded after `lead`, unless it starts with a line end.

    When half of `most` is new, the older half goes, but for what was asked for again.
    """

    def __init__(self, encode, lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most, self.old = encode, lead, most, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.fresh(part)
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def fresh(self, part: str) -> bytes:
        line = part[:1] == "\n"
        core = part[1:] if line else part
        # Long parts, and white space inside that isn't a blank or a line end.
        if len(part) > 64 or core.split() != [core]:
            raise _Odd
        return array("I", self.encode(part if line else self.lead + part)).tobytes()


class Encoder:
    """Texts to little-endian 32-bit ids followed by the end id; words are remembered up to `most`.

    Whole texts go through `tokenizers`. Single words go through `tiktoken` with the same file's vocabulary as ranks,
    which gives the same ids in a third of the time (tests compare both).
    """

    def __init__(self, path: str, end: int = 0, most: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = [t["content"] for t in file.get("added_tokens") or []]
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        self.plain = not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        if self.plain:
            signs, own = byte_signs(), set(self.added)
            ranks = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items() if token not in own}
            word = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.words, self.heads = _Words(word, " ", most), _Words(word, "", most // 5)
        self.end = np.array([end], "<u4").tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str] | None:
        """Parts for the words' path, or None: white space other than single blanks and line ends, or added tokens."""
        if not self.plain or any(t in text for t in self.added):
            return None
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n" or not text:
            return None
        return text.replace("\n", " \n").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            parts = self.units(text)
            try:
                if parts is None:
                    raise _Odd
                out[k] = b"".join([self.heads[parts[0]], *map(self.words.__getitem__, parts[1:]), self.end])
            except _Odd:
                rest.append(k)
        for k, ids in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
            out[k] = ids + self.end
        return out


class Packer:
    """Open windows of one partition; closed sequences leave through `out` as piece rows."""

    def __init__(self, first: int, width: int, windows: int, fill: int):
        self.width, self.most, self.fill, self.next = width, windows, fill, first
        self.open: list[list] = []  # [used, pieces]
        self.out: list[tuple] = []

    def close(self, pieces: list[tuple], ids: bool = False) -> None:
        at = 0
        for doc, start, buf, total in pieces:
            n = len(buf) // 4
            self.out.append((doc, start, n, zlib.crc32(buf), total, self.next, at, buf if ids else None))
            at += n
        self.next += 1

    def add(self, doc, buf: bytes) -> None:
        total, start, w = len(buf) // 4, 0, self.width
        while total - start >= w:
            self.close([(doc, start, buf[4 * start : 4 * (start + w)], total)])
            start += w
        while start < total:
            n = total - start
            fits = [x for x in self.open if x[0] + n <= w]
            if fits:
                best = max(fits, key=lambda x: x[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda x: x[0])
                if w - best[0] >= self.fill:
                    n = w - best[0]
                else:
                    self.open.remove(best)
                    self.close(best[1])
                    continue
            best[1].append((doc, start, buf[4 * start : 4 * (start + n)], total))
            best[0] += n
            start += n
            if best[0] == w:
                self.open.remove(best)
                self.close(best[1])

    def leave(self) -> None:
        for _, pieces in self.open:
            self.close(pieces, ids=True)
        self.open = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, windows: int = WINDOWS, fill: int = FILL, merge: int = MERGE, end: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a tokenizer file that every executor has. A null text counts as empty: its only id is
    the end id. A null doc_id keeps its pieces; repeated rows are packed each. No rows give no rows. Each id lies in
    exactly one piece, and offsets are gapless in a sequence.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        encode, packer = per_process((tokenizer, end), lambda: Encoder(tokenizer, end)), Packer(part << 32, width, windows, fill)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            i = 0
            while i < len(ids):
                some, size = [], 0
                while i + len(some) < len(ids) and size < 2_000_000:
                    some.append(texts[i + len(some)].as_py() or "")
                    size += len(some[-1])
                for doc, buf in zip(ids[i : i + len(some)], encode(some), strict=True):
                    packer.add(doc, buf)
                i += len(some)
                if packer.out:
                    yield _batch(packer.out)
                    packer.out = []
        packer.leave()
        yield _batch(packer.out)

    pieces = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SPARK_PIECES))

    def join(key, rows):
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer, window, used = Packer((1 << 62) + (key[0].as_py() << 32), width, 1, 1), [], 0
        for doc, start, buf, total in zip(*(rows[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            while buf:
                n = min(len(buf) // 4, width - used)
                window.append((doc, start, buf[: 4 * n], total))
                buf, start, used = buf[4 * n :], start + n, used + n
                if used == width:
                    packer.close(window)
                    window, used = [], 0
        if window:
            packer.close(window)
        return pa.Table.from_batches([_batch(packer.out)])

    whole = pieces.filter("ids is null")
    # A partition leaves fewer than `windows` windows, a group `merge` times that: a bounded group whatever the input.
    rest = pieces.filter("ids is not null").withColumn("part", F.shiftright("sequence_id", 32)).groupBy(F.floor(F.col("part") / merge).alias("own")).applyInArrow(join, SPARK_PIECES)
    return whole.drop("ids").union(rest.drop("ids"))
