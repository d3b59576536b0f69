"""A small ridge logistic regression for features that Spark has already reduced to a few numbers a row."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept first) by Newton steps; without both classes the weights give the smoothed base rate."""
    width = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = x.std(axis=0) if len(x) else np.ones(width)
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = np.zeros(width + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return mean, scale, w
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    penalty = np.full(width + 1, ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def predict(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))


def fit_around(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Logistic weights (an intercept is a column of ones) that leave ``prior`` only as far as the data outweigh the ridge."""
    w = prior.astype(np.float64).copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
