"""Areas of intersections of polygons, for whole Arrow batches at a time.

Both multipolygons are signed sums of rings (holes count less). A ring of the right side that is convex is a
clipping piece as it is, others fall into triangles. Every ring of the left side is clipped to every piece by Sutherland's and
Hodgman's method, with all pairs of similar size side by side in numpy; the signed areas of what is left add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Arrow's type of a multipolygon.
SHAPES = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
#: Points of rings and pieces that are clipped side by side.
STEP_POINTS = 1 << 19


class _Rings:
    """Signed counter-clockwise rings of a column of multipolygons, with the row of each: points (x, y) from start to start + size."""

    def __init__(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, sign: np.ndarray, row: np.ndarray):
        self.points, self.start, self.size, self.sign, self.row = points, start, size, sign, row

    @classmethod
    def of(cls, column: pa.Array) -> _Rings:
        column = column.cast(SHAPES)
        rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        polygons = column.flatten()
        per = polygons.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, first = np.repeat(rows, per), np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
        rings = polygons.flatten()
        size = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        outer = np.zeros(len(rings), dtype=bool)
        outer[first[per > 0]] = True
        pairs = rings.flatten()
        points = pairs.flatten().to_numpy(zero_copy_only=False).reshape(len(pairs), -1)[:, :2] if len(pairs) else np.empty((0, 2))
        start = np.cumsum(size) - size
        turn = cls._doubled(points, start, size)
        keep = turn != 0
        out = cls(points, start[keep], size[keep], (np.where(outer, 1.0, -1.0) * np.sign(turn))[keep], row[keep])
        return out

    @staticmethod
    def _doubled(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Twice the signed areas, by points relative to the ring's first."""
        if not len(points):
            return np.zeros(len(size))
        ring = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(ring))
        following = np.where(at + 1 < (start + size)[ring], at + 1, start[ring])
        p = points - points[start[ring]]
        q = points[following] - points[start[ring]]
        return np.bincount(ring, weights=p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], minlength=len(size))

    def _apart(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rings' own points, one ring after the other, with starts and sizes."""
        ends = np.cumsum(self.size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start - (ends - self.size), self.size)
        return self.points[at], ends - self.size, self.size

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """Points (ring, width, 2) of some rings; the last one is repeated."""
        at = np.minimum(np.arange(width), self.size[which][:, None] - 1)
        return self.points[self.start[which][:, None] + at]

    def convex(self) -> np.ndarray:
        """Whether each ring turns one way and goes round once."""
        out = np.zeros(len(self.size), dtype=bool)
        for width, which in _by_width(self.size):
            p = self.padded(which, width)
            side = np.roll(p, -1, axis=1) - p
            still = (side == 0).all(axis=2)
            # A side of no length takes the direction of the one before.
            for k in range(1, width):
                side[:, k] = np.where(still[:, k, None], side[:, k - 1], side[:, k])
            after = np.roll(side, -1, axis=1)
            cross = side[..., 0] * after[..., 1] - side[..., 1] * after[..., 0]
            angle = np.arctan2(cross, (side * after).sum(axis=2)).sum(axis=1)
            one_way = (cross >= 0).all(axis=1) | (cross <= 0).all(axis=1)
            out[which] = one_way & (np.abs(np.abs(angle) - 2 * np.pi) < 1e-6)
        return out

    def pieces(self) -> _Rings:
        """Convex rings as they are and the triangles from the first point of others."""
        convex = self.convex()
        # A clipped area takes no sign from a piece, so a ring as a piece has only that of a hole.
        way = np.sign(self._doubled(*self._apart()))
        whole = [self.points, self.start[convex], self.size[convex], (self.sign * way)[convex], self.row[convex]]
        rest = np.flatnonzero(~convex & (self.size > 2))
        if not len(rest):
            return _Rings(*whole)
        count = self.size[rest] - 2
        ring = np.repeat(rest, count)
        k = np.arange(len(ring)) - np.repeat(np.cumsum(count) - count, count) + 1
        corners = np.stack([self.start[ring], self.start[ring] + k, self.start[ring] + k + 1], axis=1)
        points = self.points[corners]
        a, b = points[:, 1] - points[:, 0], points[:, 2] - points[:, 0]
        turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        keep = turn != 0
        # The ring's own sign already counts the way it turns.
        sign = self.sign[ring] * np.sign(turn)
        start = len(self.points) + 3 * np.arange(int(keep.sum()))
        return _Rings(
            np.concatenate([self.points, points[keep].reshape(-1, 2)]),
            np.concatenate([whole[1], start]),
            np.concatenate([whole[2], np.full(len(start), 3)]),
            np.concatenate([whole[3], sign[keep]]),
            np.concatenate([whole[4], self.row[ring][keep]]),
        )


def _by_width(size: np.ndarray):
    """(width, which) for rings of similar size: widths go up by about a quarter."""
    widths, w = [3], 3
    while w < size.max(initial=3):
        w = max(w + 1, w * 5 // 4)
        widths.append(w)
    place = np.searchsorted(widths, size)
    for k in np.unique(place):
        yield widths[k], np.flatnonzero(place == k)


def _clipped(ring: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Signed areas of rings (n, a, 2) inside convex pieces (n, b, 2), relative to the pieces' first corners."""
    origin = piece[:, :1]
    ring, piece = ring - origin, piece - origin
    way = np.sign((piece[..., 0] * np.roll(piece[..., 1], -1, axis=1) - np.roll(piece[..., 0], -1, axis=1) * piece[..., 1]).sum(axis=1))
    alive = np.arange(len(ring))
    for k in range(piece.shape[1]):
        a, b = piece[alive, k], piece[alive, (k + 1) % piece.shape[1]]
        d = (b - a) * way[alive, None]
        side = d[:, 0, None] * (ring[..., 1] - a[:, 1, None]) - d[:, 1, None] * (ring[..., 0] - a[:, 0, None])
        inside = side >= 0
        if inside.all():
            continue
        before, side_before = np.roll(ring, 1, axis=1), np.roll(side, 1, axis=1)
        crosses = inside != np.roll(inside, 1, axis=1)
        f = np.where(crosses, side_before / np.where(crosses, side_before - side, 1.0), 0.0)
        # Of each point first where its side crosses the line, then the point itself.
        made = np.stack([before + f[..., None] * (ring - before), ring], axis=2).reshape(len(ring), -1, 2)
        there = np.stack([crosses, inside], axis=2).reshape(len(ring), -1)
        count = there.sum(axis=1)
        order = np.argsort(~there, axis=1, kind="stable")[:, : max(1, int(count.max(initial=1)))]
        order = np.where(np.arange(order.shape[1]) < count[:, None], order, order[:, :1])
        ring = np.take_along_axis(made, order[..., None], axis=1)
        some = count > 2
        ring, alive = ring[some], alive[some]
    out = np.zeros(len(piece))
    p, q = ring, np.roll(ring, -1, axis=1)
    out[alive] = (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(axis=1) / 2
    return out


def overlap_areas(one: pa.Array, two: pa.Array, which: np.ndarray | None = None) -> np.ndarray:
    """Area of the intersection of the multipolygons of each row; 0 for null. With `which`, row k of one meets row which[k] of two."""
    left, right = _Rings.of(one), _Rings.of(two).pieces()
    out = np.zeros(len(one))
    order = np.argsort(right.row, kind="stable")
    per_row = np.bincount(right.row, minlength=len(two))
    first = np.cumsum(per_row) - per_row
    partner = left.row if which is None else which[left.row]
    count = per_row[partner]
    a = np.repeat(np.arange(len(left.row)), count)
    b = order[np.repeat(first[partner], count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)]
    for wide, some in _by_width(left.size[a]):
        for narrow, own in _by_width(right.size[b[some]]):
            jobs = some[own]
            step = max(1, STEP_POINTS // (wide + narrow))
            for s in range(0, len(jobs), step):
                i, j = a[jobs[s : s + step]], b[jobs[s : s + step]]
                areas = _clipped(left.padded(i, wide), right.padded(j, narrow)) * left.sign[i] * right.sign[j]
                out += np.bincount(left.row[i], weights=areas, minlength=len(out))
    return np.maximum(out, 0.0)
