"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the non-decreasing fit of positive / weight over sorted x; bins of weight 0 are skipped."""
    keep = weight > 0
    x, positive, weight = x[keep], positive[keep].astype(float), weight[keep].astype(float)
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, p, w in zip(x[order], positive[order], weight[order]):
        blocks.append([p, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, w, _, last = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += w
            blocks[-1][3] = last
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([v for b in blocks for v in [b[0] / b[1]] * 2])
    return knots, values


def apply(knots: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Linear between knots, constant beyond; from 0 to 1."""
    return np.clip(np.interp(x, knots, values), 0.0, 1.0)
