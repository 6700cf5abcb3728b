"""Small linear models, fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic_towards(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float, pull: float, steps: int = 4000) -> tuple[np.ndarray, float]:
    """(weights, bias) of logistic regression whose weights are not negative and are pulled towards prior, by accelerated projected gradient."""
    w = v = np.append(prior, bias)
    if not len(x):
        return prior, bias
    a = np.hstack([x, np.ones((len(x), 1))])
    reg = np.append(np.full(len(prior), pull), 1e-6)
    rate = 1 / (0.25 * np.linalg.eigvalsh(a.T @ a / len(a))[-1] + pull)
    low, start = np.append(np.zeros(len(prior)), -np.inf), w
    for k in range(steps):
        new = np.maximum(low, v - rate * (a.T @ (sigmoid(a @ v) - y) / len(a) + reg * (v - start)))
        v = new + k / (k + 3) * (new - w)
        done, w = np.abs(new - w).max() < 1e-9, new
        if done:
            break
    return w[:-1], float(w[-1])


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear support vector machine with squared hinge loss, y in {-1, 1}, classes weighted alike, by accelerated gradient."""
    n, d = x.shape
    if n == 0 or len(np.unique(y)) < 2:
        return np.zeros(d), float(y[0]) if n else 0.0
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(d + 1, x.dtype)
    rate, y = x.dtype.type(1 / (2 * float((c * ((x * x).sum(1) + 1)).sum()) + ridge)), y.astype(x.dtype)
    for k in range(steps):
        m = 1 - y * (x @ v[:-1] + v[-1])
        g = -2 * c * y * np.maximum(m, 0)
        grad = np.append(g @ x, g.sum()) + x.dtype.type(ridge) * np.append(v[:-1], x.dtype.type(0))
        new = v - rate * grad
        v = new + x.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])
