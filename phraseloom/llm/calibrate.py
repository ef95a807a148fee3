"""Logistic calibration by Newton steps, with a ridge toward given weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first is the intercept

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, prior: np.ndarray | None = None, standardise: bool = True, steps: int = 60) -> Logistic:
    """``prior``: intercept and weights to which the ridge pulls (zero by default); the intercept is pulled weakly."""
    n, k = x.shape
    mean = x.mean(axis=0) if standardise and n else np.zeros(k)
    scale = x.std(axis=0) + 1e-9 if standardise and n else np.ones(k)
    design = np.concatenate([np.ones((n, 1)), (x - mean) / scale], axis=1)
    aim = np.zeros(k + 1) if prior is None else np.asarray(prior, float)
    pull = np.full(k + 1, ridge)
    pull[0] = 1e-3
    w = aim.copy()

    def loss(w):
        z = design @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (pull * (w - aim) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + pull * (w - aim)
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + np.diag(pull), gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-9:
            break
        now = new
    return Logistic(mean, scale, w)
