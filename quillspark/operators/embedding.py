"""Turning texts into vectors through a pluggable embedder, with token information.

`HashEmbedder` is a stand-in for a trained model: same interface, no learned meaning.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RetrievalError
from .batches import slices

TOKEN = re.compile(r"\S+")


class HashEmbedder:
    """Each token adds 1 or -1 to one of `dim` places, by its md5; vectors have unit length.

    A text without tokens gets 1 in the first place. Tokens are runs of anything but white space; two markers count too.
    Like a model with a window, it sees the first `max_tokens` alone; None takes in whole texts.
    """

    name = "hash-stand-in"

    def __init__(self, dim: int = 64, max_tokens: int | None = 256):
        self.dim, self.max_tokens = dim, max_tokens

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for token in TOKEN.findall(t)[: self.max_tokens and self.max_tokens - 2]:
                h = int(hashlib.md5(token.lower().encode()).hexdigest()[:8], 16)
                v[h % self.dim] += 1 if (h >> 31) & 1 else -1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else [1.0] + [0.0] * (self.dim - 1))
        return out

    def token_info(self, text: str) -> tuple[int, int, bool, int]:
        """Tokens with markers, the limit, whether the text is cut, and how many characters are seen."""
        tokens = list(TOKEN.finditer(text))
        n, limit = len(tokens) + 2, self.max_tokens or (1 << 31) - 1
        return n, limit, n > limit, tokens[limit - 3].end() if n > limit else len(text)


class WorkerModel:
    """An embedder whose model is made by `load()` once in each worker process, when it is first needed.

    `load` gives an object with encode(texts) -> vectors and count(text) -> (tokens, characters that are seen). Only
    `load` travels to the workers, never the model. A model of another dimension than `dim` is an error.
    """

    def __init__(self, name: str, dim: int, load, max_tokens: int = 256):
        self.name, self.dim, self.load, self.max_tokens = name, dim, load, max_tokens

    def _model(self):
        import sys
        import types

        # In a module of its own, so that it outlives the task whatever this class was shipped as.
        kept = sys.modules.setdefault("quillspark_models", types.ModuleType("quillspark_models")).__dict__
        if self.name not in kept:
            kept[self.name] = self.load()
        return kept[self.name]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = [[float(x) for x in v] for v in self._model().encode(texts)]
        if any(len(v) != self.dim for v in out):
            raise RetrievalError(f"the model {self.name} does not give {self.dim} dimensions")
        return out

    def token_info(self, text: str) -> tuple[int, int, bool, int]:
        n, seen = self._model().count(text)
        return n, self.max_tokens, n > self.max_tokens, seen


def pooled(states: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Means of each text's own token vectors, of unit length: states are (texts, places, dim), of which the first `sizes` are a text's.

    Each sum runs over a text's own places alone, so the padding of a batch changes nothing, not even the last bit. Vectors without
    a direction stay zero.
    """
    mean = np.stack([s[:n].astype(np.float64).sum(axis=0) / max(n, 1) for s, n in zip(states, sizes, strict=True)])
    size = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
    return np.divide(mean, size, out=np.zeros_like(mean), where=size > 0)


class TokenModel(WorkerModel):
    """A model that gives a vector for each token; texts are batched by their number of tokens, and token vectors pooled here.

    `load` gives an object with tokens(text) -> (ids, ends: the character after each token; markers end at 0 or at the last one) and
    states(ids, mask) -> (texts, places, dim) for a padded matrix. A text is cut to `max_tokens` ids, its last one kept as the
    closing marker. Batches hold texts of like length and at most `batch_tokens` places, padding included.
    """

    def __init__(self, name: str, dim: int, load, max_tokens: int = 256, batch_tokens: int = 4096):
        super().__init__(name, dim, load, max_tokens)
        self.batch_tokens = batch_tokens

    def _ids(self, text: str) -> list[int]:
        ids = self._model().tokens(text)[0]
        return ids if len(ids) <= self.max_tokens else [*ids[: self.max_tokens - 1], ids[-1]]

    def embed(self, texts: list[str]) -> list[list[float]]:
        ids = [self._ids(t) for t in texts]
        order, out, at = sorted(range(len(texts)), key=lambda i: len(ids[i])), [[]] * len(texts), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(ids[order[end]]) * (end + 1 - at) <= self.batch_tokens:
                end += 1
            own = [ids[i] for i in order[at:end]]
            sizes, width = [len(x) for x in own], max(map(len, own))
            matrix = np.array([x + [0] * (width - len(x)) for x in own], np.int64).reshape(len(own), width)
            states = np.asarray(self._model().states(matrix, np.arange(width) < np.array(sizes)[:, None]))
            if states.shape != (*matrix.shape, self.dim):
                raise RetrievalError(f"the model {self.name} does not give {self.dim} dimensions")
            for i, v in zip(order[at:end], pooled(states, sizes).tolist(), strict=True):
                out[i] = v
            at = end
        return out

    def token_info(self, text: str) -> tuple[int, int, bool, int]:
        ids, ends = self._model().tokens(text)
        cut = len(ids) > self.max_tokens
        return len(ids), self.max_tokens, cut, ends[self.max_tokens - 2] if cut else len(text)


class HashStates:
    """A stand-in for a token model: four numbers from each token's md5; a marker on both sides, number 0."""

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        found = list(TOKEN.finditer(text))
        ids = [int(hashlib.md5(m[0].lower().encode()).hexdigest()[:8], 16) for m in found]
        return [0, *ids, 0], [0, *(m.end() for m in found), len(text)]

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return (ids[:, :, None] >> np.array([24, 16, 8, 0]) & 255) / 255 - 0.5


def embed(df: DataFrame, embedder, text: str = "embedding_text", batch: int = 16) -> DataFrame:
    """df with embedding, embedding_model, embedding_dim and token_info. The embedder runs batch-wise in Python workers."""
    at = df.columns.index(text)
    info = "struct<token_count:int,max_seq_length:int,truncated:boolean,embedded_chars:int>"

    def run(batches):
        for b in slices(batches, text):
            texts = [t or "" for t in b.column(at).to_pylist()]
            # A token model forms batches itself, by length.
            step = len(texts) or 1 if isinstance(embedder, TokenModel) else batch
            vectors = [v for i in range(0, len(texts), step) for v in embedder.embed(texts[i : i + step])]
            if any(len(v) != embedder.dim for v in vectors):
                raise RetrievalError(f"the model's vectors do not have {embedder.dim} dimensions")
            infos = [dict(zip(("token_count", "max_seq_length", "truncated", "embedded_chars"), embedder.token_info(t), strict=True)) for t in texts]
            kind = pa.struct([("token_count", pa.int32()), ("max_seq_length", pa.int32()), ("truncated", pa.bool_()), ("embedded_chars", pa.int32())])
            arrays = [*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([embedder.name] * len(texts)), pa.array([embedder.dim] * len(texts), pa.int32()), pa.array(infos, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "embedding", "embedding_model", "embedding_dim", "token_info"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, embedding array<float>, embedding_model string, embedding_dim int, token_info {info}")


def truncated(df: DataFrame, text: str = "embedding_text") -> DataFrame:
    """Rows whose text the model does not see to its end, with the unseen tail."""
    from ..functions.text import strip

    tail = F.substring(F.col(text), F.col("token_info.embedded_chars") + 1, F.length(text))
    return df.filter("token_info.truncated").withColumn("unseen", strip(tail))


def sha256_of(df: DataFrame) -> Column:
    return F.sha2(df["content"], 256)
