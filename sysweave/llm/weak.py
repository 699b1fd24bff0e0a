"""Weak labels: how far each of several voters can be trusted, from their votes alone."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def reliabilities(
    votes: np.ndarray,
    counts: np.ndarray,
    group: np.ndarray,
    start: tuple[float, float] = (0.8, 0.2),
    rounds: int = 100,
    known: np.ndarray | float = np.nan,
):
    """Expectation-maximisation over vote patterns.

    ``votes`` has a row for each pattern and a column for each voter: 1, -1 or 0
    for no vote; ``counts`` says how often a pattern occurs and ``group`` which
    prior it shares. A voter that votes is right with a probability of its own,
    for each of the two classes; no vote says nothing. ``start`` has a first guess of how
    often a voter that votes says 1 in the class 1 and in the other; ``known`` is the
    probability of the class 1 for each pattern where that is known, else not a number. Returns (posterior of the
    class 1 for each pattern, prior by group, probabilities of a vote for 1 by
    voter and class).
    """
    n_groups = int(group.max(initial=-1)) + 1
    prior = np.full(n_groups, 0.5)
    right = np.tile([start], (votes.shape[1], 1))
    posterior = np.full(len(votes), 0.5)
    for _ in range(rounds):
        logit = np.log(prior[group]) - np.log(1 - prior[group])
        logit = logit + (votes == 1) @ np.log(right[:, 0] / right[:, 1])
        logit = logit + (votes == -1) @ np.log((1 - right[:, 0]) / (1 - right[:, 1]))
        posterior = np.where(np.isnan(known), sigmoid(logit), known)
        good, bad = counts * posterior, counts * (1 - posterior)
        # A few imagined cases keep the probabilities inside (0, 1).
        prior = (np.bincount(group, good, n_groups) + 1) / (
            np.bincount(group, counts, n_groups) + 2
        )
        before = right
        right = np.stack(
            [
                ((votes == 1).T @ w + 4 * guess) / ((votes != 0).T @ w + 4)
                for w, guess in zip((good, bad), start, strict=True)
            ],
            1,
        )
        if np.abs(right - before).max(initial=0) < 1e-7:
            break
    return posterior, prior, right


def train_linear(
    slots: np.ndarray, rows: np.ndarray, values: np.ndarray, labels: np.ndarray,
    size: int, weights: np.ndarray | None = None, rounds: int = 300, decay: float = 1e-4,
) -> np.ndarray:
    """Weights of a logistic scorer over hashed features, for labels between 0 and 1.

    Feature ``slots[i]`` has ``values[i]`` in row ``rows[i]``. Full gradients with
    a step for each weight (Adagrad), so the result does not depend on an order.
    """
    n = len(labels)
    weights = np.zeros(size) if weights is None else weights
    if not n:
        return weights
    squares = np.full(size, 1e-8)
    for _ in range(rounds):
        score = np.bincount(rows, weights[slots] * values, n)
        error = (sigmoid(score) - labels) / n
        gradient = np.bincount(slots, error[rows] * values, size) + decay * weights
        squares += gradient**2
        weights = weights - 0.5 * gradient / np.sqrt(squares)
    return weights
