"""Predicates and overlaps of two general polygons, for whole Arrow batches at once.

A batch of geometries (see `geometry`) is laid out as arrays of edges with the number of their row. Edges of the two
geometries of a row are paired in chunks of bounded size, and all pairs of a chunk are handled by numpy together;
no Python runs per row, ring or edge. Rows whose two geometries are both rectangles are decided by their sides.

Area of an intersection: a polygon is the signed sum, over its edges, of the regions below them; so an overlap is
the signed sum over pairs of edges of the area below both, which has a closed form. Holes and several parts need
nothing besides.

`contains`, `within` and `equals` compare areas with a relative tolerance of 1e-9: what sticks out by less doesn't
count. `intersects` counts shared borders. A null geometry gives null; one without rings is in nothing and
intersects nothing. Rings of fewer than four points are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-9
_AT_ONCE = 1 << 20  # pairs of edges


@dataclass
class Edges:
    """Edges in order of rows: n rows, each edge's row and ends, where each row's edges start, and which rows are null."""

    n: int
    row: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    ring: np.ndarray
    null: np.ndarray

    def __post_init__(self) -> None:
        self.count = np.bincount(self.row, minlength=self.n)
        self.start = np.cumsum(self.count) - self.count

    def taken(self, rows: np.ndarray) -> Edges:
        """Of these rows (a mask), numbered anew."""
        own = rows[self.row]
        number = np.cumsum(rows) - 1
        return Edges(int(rows.sum()), number[self.row[own]], *(c[own] for c in (self.x1, self.y1, self.x2, self.y2, self.ring)), self.null[rows])

    def bounds(self) -> np.ndarray:
        """minx, miny, maxx, maxy per row; inf and -inf without edges."""
        out = np.empty((self.n, 4))
        out[:, :2], out[:, 2:] = np.inf, -np.inf
        for k, (a, f) in enumerate(((self.x1, np.minimum), (self.y1, np.minimum), (self.x1, np.maximum), (self.y1, np.maximum))):
            f.at(out[:, k], self.row, a)
        return out

    def boxes(self) -> np.ndarray:
        """Which rows are one rectangle: four edges in one ring, turn about along x and along y."""
        along = (self.x1 == self.x2) != (self.y1 == self.y2)
        four = (self.count == 4) & (np.bincount(self.row, along, self.n) == 4)
        at = self.start[four]
        out = np.zeros(self.n, bool)
        turn = np.ones(len(at), bool)
        for k in range(3):
            turn &= ((self.x1 == self.x2)[at + k] != (self.x1 == self.x2)[at + k + 1]) & (self.ring[at + k] == self.ring[at + k + 1])
        out[four] = turn
        return out


def edges_of(geom: pa.Array) -> Edges:
    rings = pc.struct_field(geom, "rings")
    null = np.asarray(pc.is_null(rings)) if len(rings) else np.zeros(0, bool)
    ring_row = pc.list_parent_indices(rings).to_numpy().astype(np.int64)
    each = pc.list_flatten(rings)
    of_point = pc.list_parent_indices(each).to_numpy().astype(np.int64)
    points = pc.list_flatten(each)
    x, y = (pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in "xy")
    size = np.bincount(of_point, minlength=len(each))
    is_edge = (of_point[:-1] == of_point[1:]) & (size[of_point[:-1]] > 3) if len(of_point) else np.zeros(0, bool)
    at = np.flatnonzero(is_edge)
    return Edges(len(geom), ring_row[of_point[at]], x[at], y[at], x[at + 1], y[at + 1], of_point[at], null)


def _pairs(n_first: np.ndarray, row: np.ndarray, other: Edges) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the things numbered by n_first (thing i is in row[i]) with other's edges of the same row, in chunks."""
    n = other.count[row]
    total = np.cumsum(n)
    at = 0
    while at < len(n_first):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + _AT_ONCE, "right")))
        own = n[at:end]
        i = np.repeat(n_first[at:end], own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(other.start[row[at:end]], own)
        yield i, j
        at = end


def areas(e: Edges) -> np.ndarray:
    """Signed area per row: positive with shells counter-clockwise."""
    x0, y0 = (np.nan_to_num(v, posinf=0.0) for v in e.bounds()[:, :2].T)
    x1, x2, y1, y2 = e.x1 - x0[e.row], e.x2 - x0[e.row], e.y1 - y0[e.row], e.y2 - y0[e.row]
    return np.bincount(e.row, (x1 * y2 - x2 * y1) / 2, e.n)


def overlaps(a: Edges, b: Edges) -> np.ndarray:
    """Area of the intersection of each row's two geometries."""
    out = np.zeros(a.n)
    box_a, box_b = a.bounds(), b.bounds()
    meet = (box_a[:, :2] < box_b[:, 2:]).all(1) & (box_b[:, :2] < box_a[:, 2:]).all(1)
    plain = a.boxes() & b.boxes() & meet
    w = np.minimum(box_a[plain, 2:], box_b[plain, 2:]) - np.maximum(box_a[plain, :2], box_b[plain, :2])
    out[plain] = w[:, 0] * w[:, 1]
    rest = meet & ~plain
    if not rest.any():
        return out
    a, b = a.taken(rest), b.taken(rest)
    x0, y0 = np.minimum(box_a[rest, :2], box_b[rest, :2]).T
    e, f = ([s.x1 - x0[s.row], s.y1 - y0[s.row], s.x2 - x0[s.row], s.y2 - y0[s.row]] for s in (a, b))
    total = np.zeros(a.n)
    for i, j in _pairs(np.arange(len(a.row)), a.row, b):
        left = np.maximum(np.minimum(e[0], e[2])[i], np.minimum(f[0], f[2])[j])
        right = np.minimum(np.maximum(e[0], e[2])[i], np.maximum(f[0], f[2])[j])
        some = right > left
        i, j, left, right = i[some], j[some], left[some], right[some]

        def height(s: list[np.ndarray], k: np.ndarray, x: np.ndarray) -> np.ndarray:
            return s[1][k] + (s[3][k] - s[1][k]) * ((x - s[0][k]) / (s[2][k] - s[0][k]))

        el, er, fl, fr = height(e, i, left), height(e, i, right), height(f, j, left), height(f, j, right)
        dl, dr = el - fl, er - fr
        same = dl * dr >= 0
        apart = np.where(same, np.abs(dl) + np.abs(dr), (dl * dl + dr * dr) / np.where(same, 1, np.abs(dl) + np.abs(dr)))
        below = (right - left) / 4 * (el + er + fl + fr - apart)
        sign = np.sign(e[0] - e[2])[i] * np.sign(f[0] - f[2])[j]
        total += np.bincount(a.row[i], sign * below, a.n)
    out[rest] = np.maximum(total, 0)
    return out


def _inside(row: np.ndarray, x: np.ndarray, y: np.ndarray, of: Edges) -> np.ndarray:
    """Which points are in the geometry of their row, by the even-odd rule."""
    odd = np.zeros(len(row), np.int64)
    for i, j in _pairs(np.arange(len(row)), row, of):
        above = (of.y1[j] > y[i]) != (of.y2[j] > y[i])
        i, j = i[above], j[above]
        hit = x[i] < (of.x2[j] - of.x1[j]) * (y[i] - of.y1[j]) / (of.y2[j] - of.y1[j]) + of.x1[j]
        odd += np.bincount(i[hit], minlength=len(row))
    return odd % 2 == 1


def meetings(a: Edges, b: Edges) -> np.ndarray:
    """Which rows' geometries share a point: edges meet, or one holds a ring of the other."""
    out = np.zeros(a.n, bool)
    box_a, box_b = a.bounds(), b.bounds()
    near = (box_a[:, :2] <= box_b[:, 2:]).all(1) & (box_b[:, :2] <= box_a[:, 2:]).all(1)
    plain = a.boxes() & b.boxes()
    out[plain & near] = True
    rest = near & ~plain
    if not rest.any():
        return out
    a, b = a.taken(rest), b.taken(rest)
    hit = np.zeros(a.n, bool)

    def turn(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def between(px, py, qx, qy, rx, ry):
        return (np.minimum(px, qx) <= rx) & (rx <= np.maximum(px, qx)) & (np.minimum(py, qy) <= ry) & (ry <= np.maximum(py, qy))

    for i, j in _pairs(np.arange(len(a.row)), a.row, b):
        p, q, u, v = (a.x1[i], a.y1[i]), (a.x2[i], a.y2[i]), (b.x1[j], b.y1[j]), (b.x2[j], b.y2[j])
        d1, d2, d3, d4 = turn(*u, *v, *p), turn(*u, *v, *q), turn(*p, *q, *u), turn(*p, *q, *v)
        cross = (d1 * d2 < 0) & (d3 * d4 < 0)
        for d, s, t, r in ((d1, u, v, p), (d2, u, v, q), (d3, p, q, u), (d4, p, q, v)):
            cross |= (d == 0) & between(*s, *t, *r)
        hit[a.row[i[cross]]] = True
    for s, t in ((a, b), (b, a)):  # no ring crosses: each is inside or outside as its first point is
        first = np.flatnonzero(np.diff(s.ring, prepend=-1) != 0)
        first = first[~hit[s.row[first]]]
        inside = _inside(s.row[first], s.x1[first], s.y1[first], t)
        hit[s.row[first[inside]]] = True
    out[rest] = hit
    return out


def holding(a: Edges, b: Edges) -> np.ndarray:
    """Which rows' second geometry lies in the first."""
    size = np.abs(areas(b))
    return (size > 0) & (size - overlaps(a, b) <= TOLERANCE * size)


def _arrow(values: np.ndarray, *sides: Edges) -> pa.Array:
    null = sides[0].null | sides[1].null
    return pa.array(values, mask=null)


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area of the intersection of two polygons, holes respected."""
    a, b = edges_of(a), edges_of(b)
    return _arrow(overlaps(a, b), a, b)


@F.arrow_udf(T.BooleanType())
def intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Two polygons share a point, borders included."""
    a, b = edges_of(a), edges_of(b)
    return _arrow(meetings(a, b), a, b)


@F.arrow_udf(T.BooleanType())
def contains(a: pa.Array, b: pa.Array) -> pa.Array:
    """The second polygon lies in the first, borders included."""
    a, b = edges_of(a), edges_of(b)
    return _arrow(holding(a, b), a, b)


@F.arrow_udf(T.BooleanType())
def within(a: pa.Array, b: pa.Array) -> pa.Array:
    """The first polygon lies in the second, borders included."""
    a, b = edges_of(a), edges_of(b)
    return _arrow(holding(b, a), a, b)


@F.arrow_udf(T.BooleanType())
def equals(a: pa.Array, b: pa.Array) -> pa.Array:
    """The two polygons are the same region, wherever their rings start and whatever vertices lie on straight lines."""
    a, b = edges_of(a), edges_of(b)
    return _arrow(holding(a, b) & holding(b, a), a, b)
