"""Clipping of many features at once on flat arrays: the tile pyramid of an Arrow batch without a loop over features.

Parts stand end to end: ``v`` (vertices x axes) and ``off`` (where each part starts, and the end). Rings are without
their repeated last vertex. The rules are those of ``geometry``: points and lines are cut to low <= v < high, rings by
one half-plane after the other, surfaces and TINs keep whole faces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .geometry import LINE, POINT, POLYGON
from .grid import EDGE


def take(v: np.ndarray, off: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices and offsets of some parts, in their order."""
    size = np.diff(off)[parts]
    new = np.concatenate([[0], np.cumsum(size)])
    return v[np.arange(new[-1]) + np.repeat(off[:-1][parts] - new[:-1], size)], new


def _between(a: np.ndarray, b: np.ndarray, t: np.ndarray, axis: int, k: np.ndarray) -> np.ndarray:
    out = a + (b - a) * t[:, None]
    out[:, axis] = k
    return out


def cut(kind: int, v: np.ndarray, off: np.ndarray, axis: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts inside [low, high), an interval a part: vertices, offsets, and the part each came from."""
    if not len(v):
        return v, np.zeros(1, np.int64), np.zeros(0, np.int64)
    size = np.diff(off)
    of = np.repeat(np.arange(len(size)), size)
    x = v[:, axis]
    if kind == POINT:
        keep = (x >= low[of]) & (x < high[of])
        count = np.bincount(of[keep], minlength=len(size))
        some = np.flatnonzero(count)
        return v[keep], np.concatenate([[0], np.cumsum(count[some])]), some
    if kind == LINE:
        return _cut_lines(v, of, x, axis, low, high)
    if kind == POLYGON:
        source = np.arange(len(size))
        for upper, k in ((False, low), (True, high)):
            v, off, own = _half_plane(v, off, axis, k[source], upper)
            source = source[own]
        return v, off, source
    some = np.flatnonzero((np.minimum.reduceat(x, off[:-1]) < high) & (np.maximum.reduceat(x, off[:-1]) >= low))
    return *take(v, off, some), some


def _cut_lines(v, of, x, axis, low, high):
    first = np.flatnonzero(of[1:] == of[:-1])  # a segment runs from a vertex to the next of the same part
    if not len(first):
        return v[:0], np.zeros(1, np.int64), np.zeros(0, np.int64)
    part = of[first]
    u, d = x[first], x[first + 1] - x[first]
    lo, hi = low[part], high[part]
    flat = d == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        ta, tb = (lo - u) / d, (hi - u) / d
    t0 = np.where(flat, 0.0, np.maximum(0.0, np.minimum(ta, tb)))
    t1 = np.where(flat, 1.0, np.minimum(1.0, np.maximum(ta, tb)))
    valid = np.where(flat, (u >= lo) & (u < hi), t0 < t1)
    joins = np.zeros(len(first), bool)
    joins[1:] = valid[1:] & valid[:-1] & (first[1:] == first[:-1] + 1) & (t1[:-1] == 1) & (t0[1:] == 0)
    s = np.flatnonzero(valid)
    first, t0, t1, part, starts = first[s], t0[s], t1[s], part[s], ~joins[s]
    a, b, rising = v[first], v[first + 1], d[s] > 0
    begin = np.where((t0 > 0)[:, None], _between(a, b, t0, axis, np.where(rising, lo[s], hi[s])), a)
    end = np.where((t1 < 1)[:, None], _between(a, b, t1, axis, np.where(rising, hi[s], lo[s])), b)
    ends = np.cumsum(starts + 1)
    out = np.empty((ends[-1] if len(ends) else 0, v.shape[1]))
    out[ends - 1] = end
    out[ends[starts] - 2] = begin[starts]
    return out, np.append(ends[starts] - 2, len(out)), part[starts]


def _half_plane(v, off, axis, k, upper):
    """Rings cut by one half-plane; rings of under three vertices go."""
    size = np.diff(off)
    of = np.repeat(np.arange(len(size)), size)
    if not len(v):
        return v, np.zeros(1, np.int64), np.zeros(0, np.int64)
    before = np.arange(len(v)) - 1
    before[off[:-1]] = off[1:] - 1
    x, limit = v[:, axis], k[of]
    inside = x < limit if upper else x >= limit
    cross = inside != inside[before]
    count = cross.astype(np.int64) + inside
    ends = np.cumsum(count)
    out = np.empty((ends[-1], v.shape[1]))
    c = np.flatnonzero(cross)
    if len(c):
        a, b = v[before[c]], v[c]
        out[ends[c] - count[c]] = _between(a, b, (limit[c] - a[:, axis]) / (b[:, axis] - a[:, axis]), axis, limit[c])
    out[ends[inside] - 1] = v[inside]
    own = np.add.reduceat(count, off[:-1])
    new = np.concatenate([[0], np.cumsum(own)])
    some = np.flatnonzero(own >= 3)
    return *take(out, new, some), some


def descend(kind: int, v: np.ndarray, off: np.ndarray, feature: np.ndarray, top: int, low: int = 0, buffer: float = 0.0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(zoom, vertices, offsets, feature of each part, tile of each part) from zoom ``low`` to ``top``. A child is cut
    from its parent, axis after axis; the root takes all parts as they are."""
    axes = v.shape[1]
    tile = np.zeros((len(feature), axes), np.int64)
    for zoom in range(top + 1):
        if zoom:
            n = 2**zoom
            for axis in range(axes):
                found = []
                for side in (0, 1):
                    child = 2 * tile[:, axis] + side
                    end = (child + 1) / n + buffer / n + np.where(child == n - 1, EDGE, 0)
                    w, o, source = cut(kind, v, off, axis, child / n - buffer / n, end)
                    own = tile[source].copy()
                    own[:, axis] = child[source]
                    found.append((w, np.diff(o), feature[source], own))
                v = np.concatenate([f[0] for f in found])
                off = np.concatenate([[0], np.cumsum(np.concatenate([f[1] for f in found]))])
                feature, tile = (np.concatenate([f[i] for f in found]) for i in (2, 3))
        if zoom >= low:
            yield zoom, v, off, feature, tile


def lengths(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The length of each line."""
    step = np.zeros(len(v))
    step[:-1] = np.hypot(*(v[1:, :2] - v[:-1, :2]).T)
    step[off[1:] - 1] = 0
    return np.add.reduceat(step, off[:-1])


def areas(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The signed area of each ring, which is without its repeated last vertex."""
    after = np.arange(len(v)) + 1
    after[off[1:] - 1] = off[:-1]
    x, y = v[:, 0], v[:, 1]
    return np.add.reduceat(x * y[after] - x[after] * y, off[:-1]) / 2


def flat(column: pa.ListArray, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, part offsets and the row of each part of a column of parts; empty parts are left out."""
    rows = column.offsets.to_numpy()
    parts = column.values
    part_off = parts.offsets.to_numpy().astype(np.int64)[rows[0] : rows[-1] + 1]
    of = np.repeat(np.arange(len(column)), np.diff(rows))
    start = parts.values.offsets.to_numpy()[part_off[0] : part_off[-1]] if len(part_off) > 1 else np.zeros(0, np.int64)
    values = parts.values.values.to_numpy(zero_copy_only=False)
    v = np.column_stack([values[start + k] for k in range(axes)]) if len(start) else np.zeros((0, axes))
    size = np.diff(part_off)
    some = size > 0
    return v.astype(np.float64), np.concatenate([[0], np.cumsum(size[some])]), of[some]


def nested(v: np.ndarray, off: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """A column of parts; ``rows`` says where each row's parts start, and the end."""
    axes = v.shape[1]
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * axes), pa.array(v.ravel()))
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), points))
