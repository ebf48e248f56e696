"""The area that axis-aligned boxes cover together, on arrays of one frame."""

from __future__ import annotations

import numpy as np

CELLS = 4_000_000  # of the grid between all edges that are looked at together
FEW = 2  # boxes that are summed cell by cell instead of by sums from the top


def covered(zones: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """How much of each box (n, 4: x, y, w, h) the union of zones (m, 4) covers.

    All edges make a grid, of which strips of some columns are filled at once; a strip's sums from the top give every box its share of it, so
    the work doesn't grow with the pairs that overlap. Zones without an area cover nothing.
    """
    zones = zones[(zones[:, 2] > 0) & (zones[:, 3] > 0)]
    out = np.zeros(len(boxes))
    live = np.flatnonzero((boxes[:, 2] > 0) & (boxes[:, 3] > 0))
    if not len(zones) or not len(live):
        return out
    corners = lambda b: (b[:, 0], b[:, 1], b[:, 0] + b[:, 2], b[:, 1] + b[:, 3])
    zl, zt, zr, zb = corners(zones)
    bl, bt, br, bb = corners(boxes[live])
    xs, ys = np.unique(np.concatenate([zl, zr, bl, br])), np.unique(np.concatenate([zt, zb, bt, bb]))
    wide, high = np.diff(xs), np.diff(ys)
    zl, zr, bl, br = (np.searchsorted(xs, v) for v in (zl, zr, bl, br))
    zt, zb, bt, bb = (np.searchsorted(ys, v) for v in (zt, zb, bt, bb))
    tall = len(ys)
    step = max(1, CELLS // tall)
    for a in range(0, len(wide), step):
        b = min(a + step, len(wide))
        here, mine = np.flatnonzero((zl < b) & (zr > a)), np.flatnonzero((bl < b) & (br > a))
        if not len(here) or not len(mine):
            continue
        left, right = np.maximum(zl[here], a) - a, np.minimum(zr[here], b) - a
        top, low = zt[here], zb[here]
        depth = np.zeros((b - a + 1, tall), dtype=np.int32)
        at = np.concatenate([left * tall + top, right * tall + low, left * tall + low, right * tall + top])
        np.add.at(depth.reshape(-1), at, np.repeat(np.array([1, -1], dtype=np.int32), 2 * len(here)))
        np.cumsum(depth, axis=0, out=depth)
        np.cumsum(depth, axis=1, out=depth)
        filled = depth[:-1, :-1] > 0
        p, q, s, t = np.maximum(bl[mine], a) - a, np.minimum(br[mine], b) - a, bt[mine], bb[mine]
        if len(mine) <= FEW:
            out[live[mine]] += [wide[a + i : a + j] @ (filled[i:j, k:n] @ high[k:n]) for i, j, k, n in zip(p, q, s, t, strict=True)]
            continue
        sums = np.zeros((b - a + 1, tall))
        part = sums[1:, 1:]
        np.multiply(filled, high, out=part)
        np.cumsum(part, axis=1, out=part)
        part *= wide[a:b, None]
        np.cumsum(part, axis=0, out=part)
        out[live[mine]] += sums[q, t] - sums[p, t] - sums[q, s] + sums[p, s]
    return out
