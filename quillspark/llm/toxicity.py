"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Features of a document: for each word, the word itself and its prefixes of 3 to 7 letters, as shares of its words.
Positives are documents marked toxic, unlabelled ones any documents; labels of 0 serve for the class prior alone.
The classifier is linear; its risk on a batch with prior p is
    p E[l(f) | positive] + max(0, E[l(-f) | unlabelled] - p E[l(-f) | positive]),  l(x) = log(1 + exp(-x)),
and where the second part is negative, the step goes up its gradient (Kiryo et al. 2017). A feature is its count by the
number of words and SMOOTH more, so that in a very short text one word isn't everything; training and scoring take the
same features. So a document's score is the sum of one number for each word, which a task remembers.

Bounds: `positives` and `unlabelled` documents (the smallest hashes of their ids), whatever their length; of a text longer than
`sample_chars` characters, PIECES pieces evenly spread over the whole of it, together as long (excerpt());
FEATURES features: those that at least LEAST positives hold, LIFT times as often as unlabelled documents and SURPRISE
standard deviations more often, the most surprising first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, tidy, words_of

POSITIVES, UNLABELLED, SAMPLE_CHARS, FEATURES, LEAST, LIFT, SURPRISE, PREFIXES, SCALE, SMOOTH = 2500, 5000, 10_000, 1000, 5, 3.0, 4.0, range(3, 8), 100, 5
#: Pieces of a long text that training takes.
PIECES = 20
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features_of(word: bytes) -> list[bytes]:
    letters = word.decode("utf-8", "replace")
    return [word] + [(letters[:n] + "*").encode("utf-8", "replace") for n in PREFIXES if len(letters) > n]


class Model:
    """Weights of features (bytes) and a bias; weights are for smoothed shares of words times SCALE."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """A function that gives a text's score; it remembers words."""
        memo = _Memo(self.weights)

        def score(text: str | None) -> float:
            words = words_of(text)
            z = self.bias + SCALE * sum(map(memo.__getitem__, words)) / (len(words) + SMOOTH)
            return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

        return score


class _Memo(dict):
    def __init__(self, weights: dict[bytes, float], most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = s = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return s


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk of a batch of positives xp and unlabelled rows xu, and the direction of descent by w and b.

    Where the part of the negatives is below zero, that direction is the one that raises it.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    fp, fu = xp @ w + b, xu @ w + b
    own, lost = prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    # Derivatives by f of the three expectations.
    plus, minus, free = -prior * sigmoid(-fp) / len(fp), prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
    gp, gu = (plus - minus, free) if lost >= 0 else (minus, -free)
    return float(own + max(0.0, lost)), gp.astype(xp.dtype) @ xp + gu.astype(xu.dtype) @ xu, float(gp.sum() + gu.sum())


def _matrix(texts: list[str]):
    """Distinct words, the number of words of each text, and (text, word, count) of each word in it."""
    number: dict[bytes, int] = {}
    sizes, rows, words, counts = [], [], [], []
    for i, t in enumerate(texts):
        own = words_of(t)
        w, c = np.unique(np.fromiter((number.setdefault(x, len(number)) for x in own), np.int64, len(own)), return_counts=True)
        sizes.append(len(own))
        rows.append(np.full(len(w), i, np.int32))
        words.append(w.astype(np.int32))
        counts.append(c.astype(np.float32))
    return list(number), np.array(sizes), *(np.concatenate(x) if x else np.empty(0, np.int32) for x in (rows, words, counts))


def train(positive: list[str], unlabelled: list[str], prior: float, steps: int = 600, seed: int = 3) -> Model:
    """Without positives every score is near 0, the prior being small; see Model for what is returned."""
    rng = np.random.default_rng(seed)
    # Copies count once: a text that many positives repeat says nothing by its other words.
    docs = [(t, k) for k, group in ((1, positive), (0, unlabelled)) for t in dict.fromkeys(group) if words_of(t)]
    y = np.array([k for _, k in docs], bool)
    vocabulary, sizes, rows, words, counts = _matrix([t for t, _ in docs])
    prior = min(max(prior, 1e-3), 0.9)
    bias = float(np.log(prior / (1 - prior)))
    if not y.any() or y.all():
        return Model({}, bias if y.any() else -10.0)
    # Features of words, and in how many documents of each kind a feature occurs: each document counts it once.
    number: dict[bytes, int] = {}
    of_word = [[number.setdefault(f, len(number)) for f in features_of(w)] for w in vocabulary]
    names, n = list(number), (int((~y).sum()), int(y.sum()))
    seen = np.zeros((2, len(names)), np.int64)
    edges = np.searchsorted(rows, np.arange(len(docs) + 1))
    for i in range(len(docs)):
        own = np.unique(np.concatenate([of_word[w] for w in words[edges[i] : edges[i + 1]]]))
        seen[int(y[i]), own] += 1
    base = (seen[0] + 1) / (n[0] + 2)
    share = seen[1] / n[1]
    # Standard deviations by which positives hold a feature more often than unlabelled documents do.
    surprise = (share - base) / np.sqrt(base * (1 - base) / n[1])
    chosen = [j for j in np.flatnonzero((seen[1] >= LEAST) & (share >= LIFT * base) & (surprise >= SURPRISE))]
    chosen = sorted(chosen, key=lambda j: (-surprise[j], names[j]))[:FEATURES]
    if not chosen:
        return Model({}, bias)
    column = {j: k for k, j in enumerate(chosen)}
    columns = [[column[j] for j in fs if j in column] for fs in of_word]
    x = np.zeros((len(docs), len(chosen)), np.float32)
    for r, w, c in zip(rows, words, counts):
        if columns[w]:
            x[r, columns[w]] += SCALE * c / (sizes[r] + SMOOTH)
    w, b, pos, un = np.zeros(len(chosen), np.float32), bias, np.flatnonzero(y), np.flatnonzero(~y)
    m, v = np.zeros(len(chosen) + 1, np.float32), np.zeros(len(chosen) + 1, np.float32)
    for step in range(1, steps + 1):
        _, gw, gb = risk(w, b, x[rng.choice(pos, 384)], x[rng.choice(un, 1536)], prior)
        g = np.append(gw + 2e-5 * w, gb).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (1 - 0.8 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({names[j]: float(c) for j, c in zip(chosen, w, strict=True) if c}, float(b))


def excerpt(text: Column, chars: int = SAMPLE_CHARS, pieces: int = PIECES) -> Column:
    """A text of at most `chars` characters whole; of a longer one, pieces from its start to its end, without words cut in two."""
    n, size = F.length(text), chars // pieces
    start = lambda i: F.floor((n - size) * i / (pieces - 1)).cast("int") + 1
    bare = lambda p: F.regexp_replace(p, r"^\S*\s|\s\S*$", "")
    spread = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: bare(F.substring(text, start(i), F.lit(size))))
    return F.when(n > chars, F.array_join(spread, " ")).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on docs (doc_id, text) and labels (doc_id, toxic); the class prior is the share of 1 among their labels.

    Rows with a null id, text or mark are no labels. Repeated labels of a document count as toxic if any is.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null").withColumn("text", excerpt(F.col("text"), sample_chars))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = marks.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    prior = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    # At most `positives` ids: a bounded table to broadcast.
    chosen = bounded_sample(own.filter("toxic = 1").select("doc_id"), "doc_id", 2 * positives, salt=7)
    pos = bounded_sample(texts.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", positives, salt=7).collect()
    un = bounded_sample(texts, "doc_id", unlabelled, salt=8).collect()
    return train([r["text"] for r in pos], [r["text"] for r in un], float(prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score 0 to 1) for each row of docs (doc_id, text), from the whole text alone.

    A null text or one without words scores what the bias gives. Null ids keep their row; repeated rows are scored
    each; no rows give no rows.
    """

    def run(batches):
        own = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own(t.as_py()) for t in b.column(1)], pa.float64())], schema=SCORED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold. Null texts score as score() says."""
    at = docs.columns.index("text")

    def run(batches):
        own = model.scorer()
        for b in batches:
            yield b.filter(pa.array([own(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
