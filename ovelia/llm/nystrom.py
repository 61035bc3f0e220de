"""Nyström features, kernel ridge regression and a linear support vector machine over them, in NumPy."""

from __future__ import annotations

import numpy as np


def inverse_root(kernel: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """M with M Mᵀ = kernel**-1, over the eigenvalues above floor times the largest."""
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    ok = value > floor * max(value.max(), 1e-12)
    return vector[:, ok] / np.sqrt(value[ok])


def ridge(features: np.ndarray, targets: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares with an unpenalised intercept: coefficients and intercepts, one column per target."""
    w = weight / weight.sum()
    fm, tm = w @ features, w @ targets
    x, y = features - fm, targets - tm
    a = (x * w[:, None]).T @ x + penalty * np.eye(x.shape[1])
    coef = np.linalg.solve(a, (x * w[:, None]).T @ y)
    return coef, tm - fm @ coef


def svm(features: np.ndarray, sign: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the support vectors of the step before."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = weight / weight.sum()
    keep = penalty * np.eye(x.shape[1])
    keep[-1, -1] = 1e-9
    coef = np.zeros(x.shape[1])
    loss = lambda c: w @ np.maximum(0, 1 - sign * (x @ c)) ** 2 + c @ keep @ c
    now = loss(coef)
    for _ in range(rounds):
        s = sign * (x @ coef) < 1
        xs = x[s] * w[s, None]
        step = np.linalg.solve(xs.T @ x[s] + keep, xs.T @ sign[s]) - coef
        size = 1.0
        while size > 1e-4 and loss(coef + size * step) > now:
            size /= 2
        coef = coef + size * step
        before, now = now, loss(coef)
        if before - now < 1e-10:
            break
    return coef[:-1], float(coef[-1])


def logistic(facts: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and shift of a weighted logistic fit, by Newton steps; a fact that would speak against the label gets slope 0.

    Facts are measured in their deviations, in which the penalty is. A step is halved until it lowers the loss.
    """
    w, used = weight / weight.sum(), list(range(facts.shape[1]))
    middle = w @ facts
    scale = np.maximum(np.sqrt(w @ (facts - middle) ** 2), 1e-9)
    while True:
        x = np.hstack([((facts - middle) / scale)[:, used], np.ones((len(facts), 1))])
        keep = np.append(np.full(len(used), penalty), penalty * 1e-6)
        loss = lambda c: w @ (np.logaddexp(0, x @ c) - label * (x @ c)) + c @ (keep * c) / 2
        coef = np.zeros(len(keep))
        now = loss(coef)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
            step, size = np.linalg.solve(h, x.T @ (w * (p - label)) + keep * coef), 1.0
            while size > 1e-6 and loss(coef - size * step) > now:
                size /= 2
            coef = coef - size * step
            before, now = now, loss(coef)
            if before - now < 1e-12:
                break
        if not used or coef[:-1].min() >= 0:
            slope = np.zeros(facts.shape[1])
            slope[used] = coef[:-1] / scale[used]
            return slope, float(coef[-1] - slope @ middle)
        used.pop(int(np.argmin(coef[:-1])))
