"""Gradient-boosted regression trees on small tables, in numpy: logistic loss, exact splits on integer-valued features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """A tree is arrays (feature, threshold, left, right, value); a negative feature marks a leaf."""

    start: float
    rate: float
    trees: list[tuple[np.ndarray, ...]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out += self.rate * value[at]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.empty(0)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int, float]:
    """(gain, feature, threshold) of the best split of some rows; gain 0 where none helps."""
    best, total_g, total_h = (0.0, -1, 0.0), g.sum(), h.sum()
    whole = total_g**2 / (total_h + smooth)
    for f in range(x.shape[1]):
        values, inverse = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        lg, lh = np.cumsum(np.bincount(inverse, g))[:-1], np.cumsum(np.bincount(inverse, h))[:-1]
        gain = lg**2 / (lh + smooth) + (total_g - lg) ** 2 / (total_h - lh + smooth) - whole
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, float(values[k] + values[k + 1]) / 2)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, smooth: float = 1.0, least: float = 0.5) -> Trees:
    """Trees fitted by second-order boosting; deterministic."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(mean / (1 - mean))), rate, [])
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes: list[list[float]] = []
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            value = g[rows].sum() / (h[rows].sum() + smooth)  # noqa: B023
            nodes.append([-1, 0, 0, 0, value])  # noqa: B023
            gain, f, t = _split(x[rows], g[rows], h[rows], smooth) if level < depth else (0.0, -1, 0.0)  # noqa: B023
            if gain > least:
                low = x[rows, f] <= t
                nodes[me][:4] = [f, t, grow(rows[low], level + 1), grow(rows[~low], level + 1)]  # noqa: B023
            else:
                step[rows] = value  # noqa: B023
            return me

        grow(np.arange(len(y)), 0)
        columns = np.array(nodes).T
        model.trees.append((columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4]))
        margin += rate * step
    return model
