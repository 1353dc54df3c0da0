"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The bytes of a text are read in windows of WINDOW bytes, in both directions. Windows overlap: a byte is labelled where it
stands at least CONTEXT bytes from both ends of its window (or where the text itself ends), so the state has read
CONTEXT bytes or more, over words and blanks alike, before it labels. Every byte of the text, blanks included, gets one
distribution over the languages; a document's probabilities are the mean over all its bytes.

Training: back-propagation through time with Adam on windows of TRAIN_BYTES bytes, cross-entropy of the document's
language at every position. It takes at most `sample_docs` documents, an equal share of each language (those with the
smallest hashes of their ids), and of each a piece of at most `sample_chars` characters from anywhere in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

WINDOW, CONTEXT, HIDDEN, STEPS, ROWS, TRAIN_BYTES = 256, 32, 8, 400, 256, 64
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 2000
#: What stands beyond the end of a window shorter than its batch: it leaves a state of zeros as it is.
PAD = 256
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Arrays have the direction (0 forwards, 1 backwards) as their first axis; z, r and n are stacked in the second."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.w = {"x": draw(2, 3 * h, 257, by=0.3), "u": draw(2, 3 * h, h, by=h**-0.5), "v": draw(2, classes, h, by=h**-0.5), "c": np.zeros((classes, 1), np.float32)}
        self.w["x"][:, :h] += 0.5  # update gates that keep much at first, for longer memory
        self.w["x"][:, :, PAD] = 0
        self.w["x"][:, :h, PAD] = 100  # z is 1 to the last bit: the state stays

    def forward(self, seqs: np.ndarray, keep: bool = False):
        """seqs: length x rows of bytes. Log-probabilities length x classes x rows, and what backward() needs."""
        w, (length, rows) = self.w, seqs.shape
        h, kind = w["u"].shape[2], w["u"].dtype
        state, trace = np.zeros((2, h, rows), kind), []
        logits = np.zeros((length, w["c"].shape[0], rows), kind)
        logits += w["c"]
        a = np.empty((2, 3 * h, rows), kind)
        for t in range(length):
            at = seqs[t], seqs[length - 1 - t]
            for k in range(2):
                np.take(w["x"][k], at[k], axis=1, out=a[k], mode="clip")
            s = w["u"] @ state
            zr = _sigmoid(a[:, : 2 * h] + s[:, : 2 * h])
            z, r, s = zr[:, :h], zr[:, h:], s[:, 2 * h :]
            n = np.tanh(a[:, 2 * h :] + r * s)
            new = n + z * (state - n)
            if keep:
                trace.append((at, state, z, r, s, n, new))
            state = new
            logits[t] += w["v"][0] @ state[0]
            logits[length - 1 - t] += w["v"][1] @ state[1]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), trace

    def backward(self, logp: np.ndarray, target: np.ndarray, trace) -> dict:
        """Gradients of the mean cross-entropy over positions."""
        w, (length, _, rows) = self.w, logp.shape
        h = w["u"].shape[2]
        d = np.exp(logp)
        d[:, target, np.arange(rows)] -= 1
        d /= rows * length
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["c"] += d.sum(axis=(0, 2))[:, None]
        carry, das = np.zeros_like(trace[0][1]), []
        for t in range(length - 1, -1, -1):
            at, before, z, r, s, n, state = trace[t]
            out = d[t], d[length - 1 - t]
            for k in range(2):
                g["v"][k] += out[k] @ state[k].T
            dh = carry + np.stack([w["v"][k].T @ out[k] for k in range(2)])
            da_n = dh * (1 - z) * (1 - n * n)
            da_z = dh * (before - n) * z * (1 - z)
            da_r = da_n * s * r * (1 - r)
            ds = np.concatenate([da_z, da_r, da_n * r], axis=1)
            g["u"] += ds @ before.transpose(0, 2, 1)
            das.append((at, np.concatenate([da_z, da_r, da_n], axis=1)))
            carry = dh * z + w["u"].transpose(0, 2, 1) @ ds
        for k in range(2):
            at = np.concatenate([a[k] for a, _ in das])
            da = np.concatenate([x[k] for _, x in das], axis=1)
            for j, row in enumerate(da):
                g["x"][k, j] += np.bincount(at, weights=row, minlength=257)
        g["x"][:, :, PAD] = 0
        return g


def windows(data: bytes, window: int = WINDOW, context: int = CONTEXT) -> list[tuple[int, int, int]]:
    """(start, first, last): windows of a text from `start` on, and the bytes first..last - 1 that each one labels."""
    n, step = len(data), window - 2 * context
    if n <= window:
        return [(0, 0, n)] if n else []
    starts = [*range(0, n - window, step), n - window]
    edges = [0, *(s + context for s in starts[1:]), n]
    return list(zip(starts, edges, edges[1:]))


def train(texts: list[str], langs: list[str], steps: int = STEPS, rows: int = ROWS, size: int = TRAIN_BYTES, seed: int = 5) -> tuple[BiGRU, list[str]]:
    """The network and the languages' names. Each step takes windows of every language alike, from anywhere in its texts."""
    rng, names = np.random.default_rng(seed), sorted(set(langs))
    net = BiGRU(len(names), seed=seed)
    by_name = {n: [d for t, k in zip(texts, langs, strict=True) if k == n and (d := t.encode("utf-8", "surrogatepass"))] for n in names}
    by_name = {n: [np.frombuffer(d, np.uint8) for d in x] for n, x in by_name.items() if x}
    if not by_name:
        return net, names
    known = [names.index(n) for n in by_name]
    pools = list(by_name.values())
    # Longer texts more often, but not in proportion.
    odds = [np.sqrt([len(d) for d in x]) for x in pools]
    odds = [o / o.sum() for o in odds]
    first, second = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        x, y = np.full((size, rows), PAD, np.int64), np.empty(rows, np.int64)
        which = rng.integers(0, len(pools), rows)
        for k in range(len(pools)):
            own = np.flatnonzero(which == k)
            for i, j in zip(own, rng.choice(len(pools[k]), len(own), p=odds[k])):
                d = pools[k][j]
                at = int(rng.integers(0, max(1, len(d) - size + 1)))
                x[: len(d) - at, i] = d[at : at + size]
            y[own] = known[k]
        logp, kept = net.forward(x, keep=True)
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, g in net.backward(logp, y, kept).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(net.w[k].dtype)
    return net, names


class Labeller:
    """Distributions of all bytes of texts, in batches of at most `rows` windows."""

    def __init__(self, net: BiGRU, classes: int, rows: int = 1024):
        self.net, self.classes, self.rows = net, classes, rows

    def positions(self, text: str) -> np.ndarray:
        """bytes x classes: the distribution of each byte of the text."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out = [np.exp(self.net.forward(data[s : s + WINDOW, None])[0])[a - s : b - s, :, 0] for s, a, b in windows(data)]
        return np.concatenate(out) if out else np.zeros((0, self.classes))

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for an empty one."""
        data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
        total = np.zeros((len(texts), self.classes))
        todo = [(len(d) if len(d) < WINDOW else WINDOW, i, *w) for i, d in enumerate(data) for w in windows(d)]
        todo.sort(key=lambda w: w[0])
        for at in range(0, len(todo), self.rows):
            some = todo[at : at + self.rows]
            length = some[-1][0]
            seqs = np.full((length, len(some)), PAD, np.int64)
            for j, (n, i, s, _, _) in enumerate(some):
                seqs[:n, j] = data[i][s : s + n]
            p = np.exp(self.net.forward(seqs)[0])
            place = np.arange(length)[:, None]
            own = (place >= [a - s for _, _, s, a, _ in some]) & (place < [b - s for _, _, s, _, b in some])
            sums = np.einsum("tcb,tb->bc", p, own.astype(p.dtype))
            np.add.at(total, [i for _, i, *_ in some], sums)
        return total / np.maximum([[len(d)] for d in data], 1) if texts else total


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[BiGRU, list[str]]:
    """Train on (doc_id, text, lang): rows with text and language, bounded as the module says."""
    n, text = F.length("text"), F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null and text <> ''")
    h = F.xxhash64(F.lit(5), "doc_id", "text")
    # A language's hashes up to a bound that its count gives: partitions pass on little more than the sample.
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")))
    own = max(1, sample_docs // max(1, counts.count()))
    share = F.least(F.lit(1.0), F.lit(1.5 * own + 100) / F.col("c"))
    rows = rows.join(F.broadcast(counts) if own > 1 else counts, "lang").filter(h / F.lit(2.0**64) + 0.5 <= share)
    start = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.greatest(n - sample_chars + 1, F.lit(1))).cast("int") + 1
    piece = rows.select("lang", h.alias("h"), F.substring("text", start, F.lit(sample_chars)).alias("piece"))
    order = Window.partitionBy("lang").orderBy("h", "piece")
    got = piece.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= own).orderBy("lang", "n").collect()
    return train([r["piece"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, net: BiGRU, names: list[str]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text), from the whole text alone.

    `und` with score 0 where the text is null or has no letter (Unicode category L), or nothing was learned. Equal
    probabilities go to the name first in order. Null ids keep their row; repeated rows are predicted each; no rows
    give no rows.
    """

    def run(batches):
        label = Labeller(net, len(names))
        for b in batches:
            ids, column, i = b.column(0), b.column(1), 0
            while i < b.num_rows:
                some, size = [], 0
                while i + len(some) < b.num_rows and size < 1_000_000:
                    some.append(column[i + len(some)].as_py() or "")
                    size += len(some[-1])
                p = label.pooled(some) if names else np.zeros((len(some), 1))
                best = p.argmax(axis=1)
                known = [bool(names and any(map(str.isalpha, t))) for t in some]
                lang = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                score = [float(min(1.0, x)) if ok else 0.0 for x, ok in zip(p.max(axis=1), known, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(some)), pa.array(lang), pa.array(score)], schema=PREDICTED)
                i += len(some)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
