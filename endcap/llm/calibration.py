"""Isotonic calibration from binned counts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Isotonic(NamedTuple):
    """A non-decreasing map from raw scores to probabilities, linear between knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


def pooled(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Blocks (weight, hits, mean x) after pooling adjacent violators."""
    blocks: list[list[float]] = []
    for xi, ni, hi in zip(x, n, hits):
        blocks.append([float(ni), float(hi), float(ni) * float(xi)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, h, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + h, blocks[-1][2] + m]
    b = np.array(blocks).reshape(-1, 3)
    b[:, 2] /= np.maximum(b[:, 0], 1e-12)
    return b


def isotonic(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> Isotonic:
    """Fit over points ``x`` (ascending) with ``hits`` of ``n`` each, n > 0.

    Blocks are drawn toward the mean by half a row, so that few rows do not give 0 or 1.
    """
    if not len(x):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    b = pooled(x, n, hits)
    mean = b[:, 1].sum() / b[:, 0].sum()
    b = pooled(b[:, 2], b[:, 0] + 0.5, b[:, 1] + 0.5 * mean)
    return Isotonic(b[:, 2], b[:, 1] / b[:, 0])
