"""Solvers for matrices whose size doesn't depend on the number of rows."""

from __future__ import annotations

import numpy as np


def ridge_solve(gram: np.ndarray, rhs: np.ndarray, ridge: float) -> np.ndarray:
    """(gram + ridge I)^-1 rhs; positive definite, by Cholesky factors."""
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    low = np.linalg.cholesky(gram + ridge * np.eye(len(gram)))
    return np.linalg.solve(low.T, np.linalg.solve(low, rhs))


def zca(covariance: np.ndarray, eps: float) -> np.ndarray:
    """Whitening V diag(1 / sqrt(e + eps)) V'."""
    e, v = np.linalg.eigh(covariance)
    return (v / np.sqrt(e + eps)) @ v.T
