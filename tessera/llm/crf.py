"""Linear-chain conditional random fields over many sequences of unequal length at once.

Sequences lie one behind another in flat arrays. Every step of a recursion handles one position of
all sequences that are long enough, so the number of Python steps is the length of the longest.
"""

from __future__ import annotations

import numpy as np


def _steps(size: np.ndarray):
    """Sequences by falling length, and how many have more than t positions."""
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    return order, live


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(score: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray):
    """Log partition of each sequence, marginals of positions, expected moves, by forward-backward.

    score: n x k; start, size: of each sequence; move: k x k from label to label.
    """
    order, live = _steps(size)
    first = start[order]
    a, b = score.copy(), np.zeros_like(score)
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        a[at] += _sum(a[at - 1][:, :, None] + move, 1)
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        b[at] = _sum(move[None] + (score[at + 1] + b[at + 1])[:, None, :], 2)
    z = np.zeros(len(size))
    some = size > 0
    z[some] = _sum(a[start[some] + size[some] - 1], 1)
    own = np.repeat(z, size)
    prob = np.exp(a + b - own[:, None])
    moved = np.zeros_like(move)
    inner = np.ones(len(score), bool)
    inner[start[some]] = False
    at = np.flatnonzero(inner)
    for lo in range(0, len(at), 65536):
        i = at[lo : lo + 65536]
        moved += np.exp(a[i - 1][:, :, None] + move + (score[i] + b[i])[:, None, :] - own[i][:, None, None]).sum(0)
    return z, prob, moved


def viterbi(score: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels; the lower label where two are equally good."""
    order, live = _steps(size)
    first = start[order]
    best, back = score.copy(), np.zeros(score.shape, np.int8)
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        x = best[at - 1][:, :, None] + move
        back[at] = x.argmax(1)
        best[at] += x.max(1)
    out = np.zeros(len(score), np.int64)
    some = size > 0
    last = start[some] + size[some] - 1
    out[last] = best[last].argmax(1)
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        out[at - 1] = back[at, out[at]]
    return out


def fit(emit, grad, params: np.ndarray, k: int, labels: np.ndarray, start: np.ndarray, size: np.ndarray, steps: int, ridge: float, allowed: np.ndarray | None = None, rate: float = 0.1):
    """Parameters and moves of greatest penalised likelihood, by Adam.

    emit(params): n x k scores; grad(n x k): gradient of the parameters. Moves that are not
    `allowed` keep a score of -20.
    """
    fixed = np.where(np.ones((k, k), bool) if allowed is None else allowed, 0.0, -20.0)
    move = fixed.copy()
    inner = np.ones(len(labels), bool)
    inner[start[size > 0]] = False
    seen = np.zeros((k, k))
    at = np.flatnonzero(inner)
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    truth = np.eye(k)[labels]
    both = [params.astype(float).copy(), move]
    m, v = [np.zeros_like(x) for x in both], [np.zeros_like(x) for x in both]
    n = max(1, len(labels))
    for step in range(1, steps + 1):
        _, prob, moved = marginals(emit(both[0]), start, size, both[1])
        slopes = [grad(truth - prob) / n - ridge * both[0], np.where(fixed < 0, 0, (seen - moved) / n - ridge * both[1])]
        for i, g in enumerate(slopes):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            both[i] = both[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return both[0], np.where(fixed < 0, fixed, both[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with a constant last, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * len(x) * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge * len(x) + 1e-9) * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, g), -3, 3)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
