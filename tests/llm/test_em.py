"""Expectation-maximisation over vote patterns against a plain loop over single candidates, and on planted truths."""

import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import pii


def plain(candidates):
    """The same model, candidate by candidate, in numpy: candidates are (base, votes)."""
    base, votes = np.array([o for o, _ in candidates]), np.array([v for _, v in candidates])
    n, size, rest = len(votes), len(pii.LABELERS), (1 - pii.START) / 2
    first = np.array([rest, 0.25 - rest + pii.START / 2, pii.START / 2 + 0.25])
    first /= first.sum()
    start = np.stack([np.tile(first, (size, 1)), np.tile(first[::-1], (size, 1))])  # class, labeler, vote
    chance, prior = start.copy(), {o: p for o, p in pii.PRIORS.items()}
    one_hot = votes[:, :, None] == np.array([-1, 0, 1])
    for _ in range(pii.ROUNDS):
        like = [np.prod((one_hot * chance[c]).sum(axis=2), axis=1) for c in (0, 1)]
        own = np.where(base, prior[True], prior[False])
        p = own * like[0] / (own * like[0] + (1 - own) * like[1])
        prior = {o: (p[base == o].sum() + pii.WORTH * pii.PRIORS[o]) / ((base == o).sum() + pii.WORTH) for o in pii.PRIORS}
        for c, w in enumerate((p, 1 - p)):
            sums = (w[:, None, None] * one_hot).sum(axis=0)
            chance[c] = (sums + pii.WORTH * start[c]) / (sums.sum(axis=1, keepdims=True) + pii.WORTH)
    assert n
    return prior, chance


def drawn(seed, n):
    """(truth, base, votes): labelers of different worth, one of them useless."""
    r = random.Random(seed)
    right = [0.9, 0.85, 0.7, 0.65, 0.6, 0.5]
    out = []
    for _ in range(n):
        base = r.random() < 0.4
        truth = r.random() < (0.95 if base else 0.3)
        out.append((truth, base, tuple(0 if r.random() < 0.2 else (1 if truth == (r.random() < q) else -1) for q in right)))
    return out


def test_em_is_that_of_single_candidates():
    rows = [(o, v) for _, o, v in drawn(1, 700)]
    counted = [(o, v, n) for (o, v), n in Counter(rows).items()]
    prior, chance = pii.Aggregator._em(counted)
    want_prior, want = plain(rows)
    assert prior == pytest.approx(want_prior, rel=1e-9)
    for i in range(len(pii.LABELERS)):
        for c in (0, 1):
            assert [chance[i][c][v] for v in (-1, 0, 1)] == pytest.approx(want[c][i].tolist(), rel=1e-9)


def test_em_finds_planted_reliabilities():
    """Better labelers get more weight, and posteriors beat the plain majority on candidates beyond the base."""
    rows = drawn(2, 6000)
    model = pii.Aggregator([("email", o, v, n) for (o, v), n in Counter((o, v) for _, o, v in rows).items()])
    prior, chance = model.reliability["email"]
    worth = [chance[i][0][1] - chance[i][1][1] for i in range(len(pii.LABELERS))]
    assert worth[0] > worth[2] > worth[5] and abs(prior[False] - 0.3) < 0.08
    beyond = [(t, v) for t, o, v in rows if not o]
    ours = sum((model.posterior("email", v) >= 0.5) == t for t, v in beyond) / len(beyond)
    majority = sum((sum(v) > 0) == t for t, v in beyond) / len(beyond)
    assert ours > majority and ours > 0.9


def test_classifier_is_at_a_minimum():
    """The weights of the final classifier: no small step lowers its loss."""
    rows = [("ip", v, n, 0.9 if sum(v) > 0 else 0.1) for v, n in Counter(v for _, _, v in drawn(3, 500)).items()]
    w = np.array(pii.Aggregator._logistic(rows, steps=4000)["ip"])
    x = np.array([[1, *v] for _, v, _, _ in rows], float)
    n, p = np.array([n for _, _, n, _ in rows], float), np.array([p for *_, p in rows])

    def loss(w):
        z = x @ w
        return (n * (np.logaddexp(0, z) - p * z)).sum() / n.sum() + pii.NEAR / 2 * ((w - np.array(pii.FIRST)) ** 2).sum()

    best = loss(w)
    for i in range(len(w)):
        for step in (-1e-3, 1e-3):
            assert loss(w + step * np.eye(len(w))[i]) > best - 1e-9
