"""A regularised mixture of two Gaussians over similarity vectors, fitted without labels to their histogram."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def densities(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Logarithms of the Gaussian density."""
    diff = x - mean
    return -0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1] + x.shape[1] * np.log(2 * np.pi))


def regularised(x: np.ndarray, weight: np.ndarray, groups: list[list[int]], kappa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and covariance; features of different groups are taken as independent, kappa is added to variances."""
    total = max(weight.sum(), 1e-9)
    mean = weight @ x / total
    diff = x - mean
    cov = (diff * weight[:, None]).T @ diff / total
    mask = np.zeros_like(cov)
    for group in groups:
        mask[np.ix_(group, group)] = 1
    return mean, cov * mask + np.diag(kappa)


def fit(x: np.ndarray, n: np.ndarray, start: np.ndarray, groups: list[list[int]], rounds: int = 200, kappa: float = 0.05, bound: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Posteriors of the matched component for the vectors x, each seen n times, from the posteriors `start`.

    kappa regularises as a share of the squared distance between the two means, feature by feature, so that a feature on
    which all matched pairs agree keeps a width.  `bound` leads the posteriors of each expectation to the mean posteriors,
    vector by vector, that the next maximisation takes."""
    gamma = start.astype(float)
    for _ in range(rounds):
        held = bound(gamma) if bound else gamma
        matched, unmatched = n * held, n * (1 - held)
        if min(matched.sum(), unmatched.sum()) < 1e-6:
            return gamma
        gap = (matched @ x / matched.sum() - unmatched @ x / unmatched.sum()) ** 2
        width = kappa * np.maximum(gap, 0.05)
        m, u = regularised(x, matched, groups, width), regularised(x, unmatched, groups, width)
        share = matched.sum() / n.sum()
        odds = densities(x, *m) - densities(x, *u) + np.log(share) - np.log(1 - share)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - gamma).max() < 1e-6:
            return new
        gamma = new
    return gamma
