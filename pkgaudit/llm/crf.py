"""Linear-chain conditional random fields over many sequences at once, with numpy.

Sequences lie one behind the other in flat arrays. All take their t-th step together, longest first,
so those that have ended fall off the end of what a step touches.
"""

from __future__ import annotations

import numpy as np


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the sequences, longest first, and how many are still going at each step."""
    order = np.argsort(-lengths, kind="stable")
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    steps = int(lengths.max()) if len(lengths) else 0
    return firsts, np.searchsorted(-lengths[order], -np.arange(steps), side="left")


def forward_backward(scores: np.ndarray, lengths: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's probability of each label, and the expected number of each pair of neighbouring labels."""
    firsts, active = _layout(lengths)
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(ties)
    ahead, behind = np.empty_like(local), np.ones_like(local)
    ahead[firsts] = local[firsts]
    for t in range(1, len(active)):
        here = firsts[:active[t]] + t
        value = (ahead[here - 1] @ move) * local[here]
        ahead[here] = value / value.sum(axis=1, keepdims=True)
    pairs = np.zeros_like(move)
    for t in range(len(active) - 1, 0, -1):
        here = firsts[:active[t]] + t
        onward = local[here] * behind[here]
        joint = ahead[here - 1][:, :, None] * move[None] * onward[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = onward @ move.T
        behind[here - 1] = value / value.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True), pairs


def viterbi(scores: np.ndarray, lengths: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The best labels of every sequence."""
    firsts, active = _layout(lengths)
    best, came = scores.copy(), np.zeros(scores.shape, np.int8)
    for t in range(1, len(active)):
        here = firsts[:active[t]] + t
        ways = best[here - 1][:, :, None] + ties[None]
        came[here] = ways.argmax(axis=1)
        best[here] += ways.max(axis=1)
    labels = best.argmax(axis=1)
    for t in range(len(active) - 1, 0, -1):
        here = firsts[:active[t]] + t
        labels[here - 1] = came[here, labels[here]]
    return labels


def fit(inputs: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_labels: int, steps: int, rate: float = 0.1,
        decay: float = 1e-3, most_tie: float = 2.0, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and ties of greatest penalised likelihood, by Adam steps over all rows.

    With `of`, inputs are the distinct ones, and `of` the number of each row's.
    """
    wanted = np.eye(n_labels)[labels]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    follows = np.ones(len(labels), bool)
    follows[firsts] = False
    at = np.flatnonzero(follows)
    observed = np.zeros((n_labels, n_labels))
    np.add.at(observed, (labels[at - 1], labels[at]), 1)
    weights, ties = np.zeros((inputs.shape[1], n_labels)), np.zeros((n_labels, n_labels))
    means = [np.zeros_like(weights), np.zeros_like(ties)]
    squares = [np.zeros_like(weights), np.zeros_like(ties)]
    for step in range(1, steps + 1):
        scores = inputs @ weights
        marginals, pairs = forward_backward(scores if of is None else scores[of], lengths, ties)
        missing = wanted - marginals
        if of is not None:
            missing = np.stack([np.bincount(of, missing[:, k], len(inputs)) for k in range(n_labels)], axis=1)
        slopes = (inputs.T @ missing / len(labels) - decay * weights,
                  (observed - pairs) / max(1, len(at)) - decay * ties)
        for k, (values, slope) in enumerate(zip((weights, ties), slopes, strict=True)):
            means[k] += 0.1 * (slope - means[k])
            squares[k] += 0.01 * (slope**2 - squares[k])
            values += rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
        # Bounded, so that no neighbour decides alone.
        np.clip(ties, -most_tie, most_tie, out=ties)
    return weights, ties
