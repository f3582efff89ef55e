"""Linear-chain conditional random fields over many token sequences at once.

Sequences are kept one after another in flat arrays, with their lengths.  Emission scores
are sums of feature weights; the recursions run over all sequences in step, longest first,
so that the work of a step is one array operation whatever the number of sequences.
"""

from __future__ import annotations

import numpy as np


class Steps:
    """The order in which tokens of ragged sequences are visited: step t holds the t-th token of each."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(self.lengths) else np.zeros(0, np.int64)
        self.starts = starts[order]
        self.sorted = self.lengths[order]
        longest = int(self.sorted[0]) if len(order) else 0
        # how many sequences have more than t tokens
        self.active = np.searchsorted(-self.sorted, -np.arange(longest), side="left").tolist()

    def __len__(self) -> int:
        return len(self.active)

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t


def forward_backward(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each token (n x k), expected transitions (k x k) and the sum of log partition values."""
    n, k = emit.shape
    top = emit.max(axis=1, keepdims=True) if n else np.zeros((0, 1))
    e = np.exp(emit - top)
    move = np.exp(trans - trans.max())
    alpha, scale = np.empty((n, k)), np.ones(n)
    for t in range(len(steps)):
        i = steps.at(t)
        a = e[i] * (np.exp(begin) if t == 0 else alpha[i - 1] @ move)
        scale[i] = s = a.sum(axis=1)
        alpha[i] = a / s[:, None]
    beta = np.ones((n, k))
    pairs = np.zeros((k, k))
    for t in range(len(steps) - 2, -1, -1):
        i = steps.at(t)[: steps.active[t + 1]]
        ahead = e[i + 1] * beta[i + 1] / scale[i + 1][:, None]
        beta[i] = ahead @ move.T
        pairs += (alpha[i].T @ ahead) * move
    marginal = alpha * beta
    total = float(np.log(scale).sum() + top.sum()) + trans.max() * float((steps.lengths - 1).clip(0).sum())
    return marginal / np.maximum(marginal.sum(axis=1, keepdims=True), 1e-300), pairs, total


def viterbi(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, steps: Steps) -> np.ndarray:
    """The best tag of each token."""
    n, k = emit.shape
    best, back = np.empty((n, k)), np.zeros((n, k), np.int8)
    for t in range(len(steps)):
        i = steps.at(t)
        if t == 0:
            best[i] = emit[i] + begin
        else:
            ways = best[i - 1][:, :, None] + trans[None]
            back[i] = ways.argmax(axis=1)
            best[i] = ways.max(axis=1) + emit[i]
    tags = np.zeros(n, np.int8)
    for t in range(len(steps) - 1, -1, -1):
        i = steps.at(t)
        going = steps.active[t + 1] if t + 1 < len(steps) else 0
        tags[i[going:]] = best[i[going:]].argmax(axis=1)
        on = i[:going]
        tags[on] = back[on + 1, tags[on + 1]]
    return tags


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of each token's features (n x f indices)."""
    out = np.zeros((len(features), weights.shape[1]))
    for f in range(features.shape[1]):
        out += weights[features[:, f]]
    return out


def train(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, n_features: int, k: int, *, rounds: int = 40, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, transitions and begin scores that maximise the likelihood of ``tags``: Adam over all sequences.

    Deterministic.  Without sequences all weights stay zero.
    """
    steps = Steps(lengths)
    n = max(len(tags), 1)
    params = [np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    own = np.zeros((len(tags), k))
    own[np.arange(len(tags)), tags] = 1
    gold = np.zeros((k, k))
    inner = np.ones(len(tags), bool)
    first = steps.starts[steps.sorted > 0]
    inner[first] = False
    at = np.flatnonzero(inner)
    np.add.at(gold, (tags[at - 1], tags[at]), 1)
    for step in range(1, rounds + 1):
        marginal, pairs, _ = forward_backward(emissions(features, params[0]), params[1], params[2], steps)
        diff = own - marginal
        grad = np.zeros_like(params[0])
        for f in range(features.shape[1]):
            for j in range(1, k):
                grad[:, j] += np.bincount(features[:, f], weights=diff[:, j], minlength=n_features)
        grad[:, 0] = -grad[:, 1:].sum(axis=1)  # a token's differences sum to nothing
        grads = [grad / n - l2 * params[0], (gold - pairs) / n - l2 * params[1], diff[first].sum(axis=0) / n - l2 * params[2]]
        for p, g, m in zip(params, grads, moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1], params[2]
