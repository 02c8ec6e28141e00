"""Numpy kernels on one volume, for volumes that fit in a task."""

from __future__ import annotations

import numpy as np

from .shipping import ship

ship(__name__)


def sobel_magnitude(v: np.ndarray) -> np.ndarray:
    """Gradient magnitude of the 3-D Sobel filters; 0 on the border and where a neighbour is absent (NaN)."""
    out = np.zeros(v.shape)
    if min(v.shape) < 3:
        return out

    def slope(a: np.ndarray, axis: int) -> np.ndarray:
        cut = [slice(None)] * 3
        cut[axis] = slice(2, None)
        high = a[tuple(cut)]
        cut[axis] = slice(None, -2)
        return high - a[tuple(cut)]

    def smoothed(a: np.ndarray, axis: int) -> np.ndarray:
        cut = [slice(None)] * 3
        parts = []
        for s in (slice(None, -2), slice(1, -1), slice(2, None)):
            cut[axis] = s
            parts.append(a[tuple(cut)])
        return parts[0] + 2 * parts[1] + parts[2]

    sx = smoothed(v, 0)
    gx = smoothed(smoothed(slope(v, 0), 1), 2)
    gy = smoothed(slope(sx, 1), 2)
    gz = slope(smoothed(sx, 1), 2)
    # a hole in the 27 cells must count even where every filter has a 0
    whole = ~np.isnan(v)
    if not whole.all():
        count = sum(whole[i : v.shape[0] - 2 + i, j : v.shape[1] - 2 + j, k : v.shape[2] - 2 + k].astype(np.int8) for i in range(3) for j in range(3) for k in range(3))
        size = np.where(count == 27, np.sqrt(gx * gx + gy * gy + gz * gz), 0.0)
    else:
        size = np.sqrt(gx * gx + gy * gy + gz * gz)
    out[1:-1, 1:-1, 1:-1] = size
    return out
