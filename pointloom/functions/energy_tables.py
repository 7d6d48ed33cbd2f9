"""Pairwise cost matrices V[k, l] of the energy families; all solve through one dense path."""

from __future__ import annotations

import numpy as np


def general(matrix) -> np.ndarray:
    return np.asarray(matrix, float)


def potts(k: int, weight: float) -> np.ndarray:
    return weight * (1 - np.eye(k))


def binary(v00: float, v01: float, v10: float, v11: float) -> np.ndarray:
    return np.array([[v00, v01], [v10, v11]], float)


binary_fast = binary


def _gap(k: int) -> np.ndarray:
    return np.abs(np.subtract.outer(np.arange(k), np.arange(k))).astype(float)


def truncated_linear(k: int, alpha: float, limit: float) -> np.ndarray:
    return np.minimum(alpha * _gap(k), limit)


def truncated_quadratic(k: int, alpha: float, limit: float) -> np.ndarray:
    return np.minimum(alpha * _gap(k) ** 2, limit)


def _gaps_2d(kx: int, ky: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels are x + kx * y."""
    x, y = np.arange(kx * ky) % kx, np.arange(kx * ky) // kx
    return np.abs(np.subtract.outer(x, x)).astype(float), np.abs(np.subtract.outer(y, y)).astype(float)


def truncated_linear_2d(kx: int, ky: int, alpha_x: float, alpha_y: float, limit: float) -> np.ndarray:
    dx, dy = _gaps_2d(kx, ky)
    return np.minimum(alpha_x * dx + alpha_y * dy, limit)


def truncated_quadratic_2d(kx: int, ky: int, alpha_x: float, alpha_y: float, limit: float) -> np.ndarray:
    dx, dy = _gaps_2d(kx, ky)
    return np.minimum(alpha_x * dx**2 + alpha_y * dy**2, limit)
