"""Polygons as well-known text, their type, and what makes them invalid.

Text is read token by token, so a long one needs no more than its own numbers. Validity is found for a whole Arrow
batch: rings are checked by size, closure and area; edges are sorted by row and x, and each is paired with those
that begin before it ends, in chunks of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import _GEOMETRY, _over_edges, geometries
from .polygons import _AT_ONCE, Edges, _pairs, edges_of

_TOKEN = re.compile(r"[(),]|[^\s(),]+")


def _number(x: float) -> str:
    text = repr(float(x))
    return text.removesuffix(".0")


def written(geom: dict | None) -> str | None:
    """POLYGON or MULTIPOLYGON; a shell, counter-clockwise, starts a part. Without rings POLYGON EMPTY."""
    if geom is None or geom["rings"] is None:
        return None
    parts: list[list[str]] = []
    for ring in geom["rings"]:
        turn = sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring[:-1], ring[1:]))
        if turn >= 0 or not parts:
            parts.append([])
        parts[-1].append("(" + ", ".join(f"{_number(p['x'])} {_number(p['y'])}" for p in ring) + ")")
    if not parts:
        return "POLYGON EMPTY"
    bodies = ["(" + ", ".join(rings) + ")" for rings in parts]
    return "POLYGON " + bodies[0] if len(bodies) == 1 else "MULTIPOLYGON (" + ", ".join(bodies) + ")"


def parsed(text: str | None, srid: int = 4326) -> dict | None:
    """Polygons and multipolygons, in any case, with `SRID=n;` before and heights, which are dropped; shells turned counter-clockwise, holes clockwise. Other text is null."""
    head = re.match(r"\s*(?:SRID\s*=\s*(\d+)\s*;)?\s*(MULTI)?POLYGON\b\s*(?:Z|M|ZM)?\s*", text or "", re.IGNORECASE)
    if not head:
        return None
    srid, deepest = int(head[1] or srid), 3 if head[2] else 2
    if text[head.end() :].strip().upper() == "EMPTY":
        return {"rings": [], "srid": srid}
    rings: list[list[dict]] = []
    depth, in_part, point, ring, done = 0, 0, [], [], False
    try:
        for m in _TOKEN.finditer(text, head.end()):
            token = m[0]
            if done:
                return None
            if token == "(":
                depth += 1
                in_part = 0 if depth == deepest - 1 else in_part
                ring = []
            elif token in "),":
                if point:
                    ring.append((point[0], point[1]))
                    point = []
                if token == ")":
                    if depth == deepest:
                        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[:-1], ring[1:]))
                        rings.append([{"x": x, "y": y} for x, y in (ring[::-1] if (turn < 0) == (in_part == 0) else ring)])
                        in_part += 1
                    depth -= 1
                    done = depth == 0
            elif depth == deepest:
                point.append(float(token))
            else:
                return None
    except (ValueError, IndexError):
        return None
    return {"rings": rings, "srid": srid} if done else None


@F.arrow_udf(T.StringType())
def to_wkt(geom: pa.Array) -> pa.Array:
    return pa.array([written(x) for x in geom.to_pylist()], pa.string())


@F.arrow_udf(_GEOMETRY)
def from_wkt(text: pa.Array) -> pa.Array:
    return geometries([parsed(t) for t in text.to_pylist()])


def geometry_type(geom: Column) -> Column:
    """POLYGON, or MULTIPOLYGON for several shells; null for a null."""
    turn = lambda r: _over_edges(r, lambda p, q: p.x * q.y - q.x * p.y)
    shells = F.size(F.filter(geom["rings"], lambda r: turn(r) > 0))
    return F.when(geom["rings"].isNotNull(), F.when(shells > 1, "MULTIPOLYGON").otherwise("POLYGON"))


def _meeting_edges(e: Edges, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows with two edges that meet where they mustn't. place: of each edge in its ring; size: edges of its ring.

    Edges of a ring may share the vertex between neighbours only; those of different rings may touch, but neither cross nor run along each other.
    """
    low, high = np.minimum(e.x1, e.x2), np.maximum(e.x1, e.x2)
    box = e.bounds()
    with np.errstate(invalid="ignore"):
        wide = np.where(box[:, 2] > box[:, 0], box[:, 2] - box[:, 0], 1.0)
    scaled = lambda v: e.row * 2.0 + (v - box[e.row, 0]) / wide[e.row]
    order = np.argsort(scaled(low), kind="stable")
    start = scaled(low)[order]
    last = np.searchsorted(start, scaled(high)[order] + 1e-9, "right")
    n = np.maximum(last - np.arange(len(order)) - 1, 0)
    total, bad, at = np.cumsum(n), np.zeros(e.n, bool), 0
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    while at < len(order):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + _AT_ONCE, "right")))
        own = n[at:end]
        a = np.repeat(np.arange(at, end), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        i, j = order[a], order[b]
        at = end
        near = (e.row[i] == e.row[j]) & (np.minimum(e.y1[i], e.y2[i]) <= np.maximum(e.y1[j], e.y2[j])) & (np.minimum(e.y1[j], e.y2[j]) <= np.maximum(e.y1[i], e.y2[i]))
        i, j = i[near], j[near]
        p, q, u, v = (e.x1[i], e.y1[i]), (e.x2[i], e.y2[i]), (e.x1[j], e.y1[j]), (e.x2[j], e.y2[j])
        d1, d2, d3, d4 = turn(*u, *v, *p), turn(*u, *v, *q), turn(*p, *q, *u), turn(*p, *q, *v)
        cross = (d1 * d2 < 0) & (d3 * d4 < 0)
        touch = cross.copy()
        for d, s, t, r in ((d1, u, v, p), (d2, u, v, q), (d3, p, q, u), (d4, p, q, v)):
            between = (np.minimum(s[0], t[0]) <= r[0]) & (r[0] <= np.maximum(s[0], t[0])) & (np.minimum(s[1], t[1]) <= r[1]) & (r[1] <= np.maximum(s[1], t[1]))
            touch |= (d == 0) & between
        level = (d1 == 0) & (d2 == 0)
        shared_x = np.minimum(np.maximum(p[0], q[0]), np.maximum(u[0], v[0])) - np.maximum(np.minimum(p[0], q[0]), np.minimum(u[0], v[0]))
        shared_y = np.minimum(np.maximum(p[1], q[1]), np.maximum(u[1], v[1])) - np.maximum(np.minimum(p[1], q[1]), np.minimum(u[1], v[1]))
        along = level & touch & ((shared_x > 0) | (shared_y > 0))
        same = e.ring[i] == e.ring[j]
        gap = np.abs(place[i] - place[j])
        neighbours = same & ((gap == 1) | (gap == size[i] - 1))
        wrong = np.where(neighbours, along, np.where(same, touch, cross | along))
        bad[e.row[i[wrong]]] = True
    return bad


def _invalid(geom: pa.Array) -> pa.Array:
    rings = pc.struct_field(geom, "rings")
    null = np.asarray(pc.is_null(rings)) if len(rings) else np.zeros(0, bool)
    row = pc.list_parent_indices(rings).to_numpy().astype(np.int64)
    each = pc.list_flatten(rings)
    points = pc.list_flatten(each)
    of = pc.list_parent_indices(each).to_numpy().astype(np.int64)
    x, y = (pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in "xy")
    n = np.bincount(of, minlength=len(each))
    start = np.cumsum(n) - n
    reason = np.full(len(geom), None, object)

    def says(which: np.ndarray, what: str) -> None:
        rows = np.unique(which)
        reason[rows[[reason[r] is None for r in rows]] if len(rows) else rows] = what

    says(row[of[~(np.isfinite(x) & np.isfinite(y))]], "not finite")
    says(row[n < 4], "too few points")
    long = np.flatnonzero(n >= 4)
    first, last = start[long], start[long] + n[long] - 1
    says(row[long[(x[first] != x[last]) | (y[first] != y[last])]], "not closed")
    e = edges_of(geom)
    fine = np.array([r is None for r in reason]) & ~null
    some = e.taken(fine) if len(fine) else e
    if len(some.row):
        number = np.flatnonzero(fine)
        begin = np.flatnonzero(np.diff(some.ring, prepend=-1) != 0)
        count = np.diff(np.append(begin, len(some.ring)))
        place, size = np.arange(len(some.ring)) - np.repeat(begin, count), np.repeat(count, count)
        zero = (some.x1 == some.x2) & (some.y1 == some.y2)
        says(number[some.row[zero]], "repeated point")
        says(number[_meeting_edges(some, place, size)], "edges meet")
        # the middle of each ring's first edge lies in no other ring's inside, or for a hole in that of one more shell than holes
        area = np.add.reduceat(((some.x1 - some.x1[np.repeat(begin, count)]) * (some.y2 - some.y1[np.repeat(begin, count)]) - (some.x2 - some.x1[np.repeat(begin, count)]) * (some.y1 - some.y1[np.repeat(begin, count)])) / 2, begin)
        mid_x, mid_y, ring_row = (some.x1[begin] + some.x2[begin]) / 2, (some.y1[begin] + some.y2[begin]) / 2, some.row[begin]
        inside = np.zeros(len(begin), np.int64)
        for i, j in _pairs(np.arange(len(begin)), ring_row, some):
            over = ((some.y1[j] > mid_y[i]) != (some.y2[j] > mid_y[i])) & (some.ring[j] != some.ring[begin[i]])
            i, j = i[over], j[over]
            hit = mid_x[i] < (some.x2[j] - some.x1[j]) * (mid_y[i] - some.y1[j]) / (some.y2[j] - some.y1[j]) + some.x1[j]
            inside += np.bincount(i[hit], minlength=len(begin))
        says(number[ring_row[area == 0]], "no area")
        says(number[ring_row[(inside % 2 == 1) != (area < 0)]], "rings nested wrongly")
    return pa.array(reason.tolist(), pa.string())


@F.arrow_udf(T.StringType())
def invalid_reason(geom: pa.Array) -> pa.Array:
    """Null for a valid polygon, an empty one or a null; else what is wrong: not finite, too few points, not closed, repeated point, edges meet, no area, rings nested wrongly."""
    return _invalid(geom)


def is_valid(geom: Column) -> Column:
    """Null for a null geometry."""
    return F.when(geom["rings"].isNotNull(), invalid_reason(geom).isNull())
