"""Small linear models, fitted on bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by dual coordinate descent; ``y`` is -1 or 1."""
    n, w, alpha = len(x), np.zeros(x.shape[1]), np.zeros(len(x))
    # each side weighs as much as the other
    upper = np.where(y > 0, c * n / max(1, 2 * (y > 0).sum()), c * n / max(1, 2 * (y < 0).sum()))
    diag = (x * x).sum(1) + 0.5 / upper
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w) - 1 + 0.5 * alpha[i] / upper[i]
            new = max(alpha[i] - g / diag[i], 0.0)
            if d := new - alpha[i]:
                w += d * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, start: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression, by Newton steps; ``y`` is 0 or 1 or between."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    w = np.zeros(a.shape[1]) if start is None else start.copy()

    def loss(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w)

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        t = 1.0
        while (then := loss(w - t * step)) > now and t > 1e-4:
            t /= 2
        w = w - t * step
        if now - then < 1e-6 * abs(now):
            break
        now = then
    return w


def logit_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
