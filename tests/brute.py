"""The statistics of the library written for one list of numbers in memory."""

import math

import numpy as np
import pandas as pd


def present(values):
    return np.array([v for v in values if v is not None], dtype=float)


def ranks(values):
    return pd.Series(values).rank(method="average").to_numpy()


def spearman(x, y):
    whole = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    if len(whole) < 2:
        return None
    a, b = ranks([w[0] for w in whole]), ranks([w[1] for w in whole])
    if a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def bandwidth(values):
    v = present(values)
    sd = v.std(ddof=1)
    q1, q3 = np.percentile(v, [25, 75])
    spread = min(sd, (q3 - q1) / 1.34) or sd or abs(v[0]) or 1.0
    return 0.9 * spread * len(v) ** -0.2


def kde(values, bw, grid):
    """Linearly binned onto 512 points, four bandwidths wider than the curve, and read off."""
    v, grid = present(values), np.asarray(grid, dtype=float)
    points = np.linspace(grid[0] - 4 * bw, grid[-1] + 4 * bw, len(grid))
    at = (v - points[0]) / (points[1] - points[0])
    low = np.floor(at).astype(int)
    weights = np.zeros(len(points))
    np.add.at(weights, low, 1 - (at - low))
    np.add.at(weights, np.minimum(low + 1, len(points) - 1), at - low)
    z = (points[:, None] - points[None, :]) / bw
    sums = (np.exp(-z * z / 2) * weights).sum(axis=1)
    return np.interp(grid, points, sums / (len(v) * bw * math.sqrt(2 * math.pi)))


def bins(values, breaks):
    """Right-closed counts, the lowest border included, borders a little to the right."""
    v = present(values)
    slack = 1e-8 * (breaks[1] - breaks[0])
    counts = []
    for i, (low, high) in enumerate(zip(breaks, breaks[1:])):
        above = v >= low - slack if i == 0 else v > low + slack
        counts.append(int((above & (v <= high + slack)).sum()))
    return counts


def box(values):
    v = present(values)
    q1, q2, q3 = np.percentile(v, [25, 50, 75])
    outside = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
    inside = v[~outside]
    low = min([q1, *inside])
    high = max([q3, *inside])
    return low, q1, q2, q3, high, int(outside.sum())
