"""Boundaries of many small groups of polygons at once, by numpy: edges cut where they meet, and which sides are covered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .polygons import _AT_ONCE, Edges

Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def numbered(table: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group, and the number of each row's group; nulls are a value."""
    key = np.zeros(len(table), np.int64)
    for k in by:
        code = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        key = np.unique(key * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number


def _distinct(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each combination of values, in order of these, and the number of each row's combination."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def spread(n: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each thing i its n[i] partners from start[i] on, in chunks of bounded size."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + _AT_ONCE, "right")))
        own = n[at:end]
        i = np.repeat(np.arange(at, end), own)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[at:end], own)
        at = end


def _runs(number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(number, minlength=n)
    return count, np.cumsum(count) - count


def _ordered(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, Ends]:
    ahead = (x1 < x2) | ((x1 == x2) & (y1 < y2))
    return ahead, tuple(np.where(ahead, a, b) for a, b in ((x1, x2), (y1, y2), (x2, x1), (y2, y1)))


def _cut(group: np.ndarray, ends: Ends, n_groups: int, digits: int) -> tuple[np.ndarray, Ends]:
    """Lines, in order of group and ends, cut where they meet: each part's line and ends."""
    ux, uy, vx, vy = ends
    near = 10.0**-digits
    dx, dy = vx - ux, vy - uy
    length = np.hypot(dx, dy)
    low, high = np.minimum(uy, vy), np.maximum(uy, vy)
    count, start = _runs(group, n_groups)
    line, at, px, py = ([a] for a in (np.tile(np.arange(len(ux)), 2), np.repeat([-1.0, 2.0], len(ux)), np.concatenate([ux, vx]), np.concatenate([uy, vy])))
    for i, j in spread(count[group], start[group]):
        met = (i != j) & (ux[i] <= vx[j]) & (ux[j] <= vx[i]) & (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[met], j[met]
        for x, y in ((ux[j], uy[j]), (vx[j], vy[j])):
            wx, wy = x - ux[i], y - uy[i]
            t = (wx * dx[i] + wy * dy[i]) / (length[i] * length[i])
            on = (np.abs(dx[i] * wy - dy[i] * wx) <= near * length[i]) & (t > 0) & (t < 1)
            on &= ((x != ux[i]) | (y != uy[i])) & ((x != vx[i]) | (y != vy[i]))
            for to, v in ((line, i), (at, t), (px, x), (py, y)):
                to.append(v[on])
        turn = dx[i] * dy[j] - dy[i] * dx[j]
        i, j, turn = i[turn != 0], j[turn != 0], turn[turn != 0]
        wx, wy = ux[j] - ux[i], uy[j] - uy[i]
        t, s = (wx * dy[j] - wy * dx[j]) / turn, (wx * dy[i] - wy * dx[i]) / turn
        reach, other = near / length[i], near / length[j]
        on = (t > reach) & (t < 1 - reach) & (s > other) & (s < 1 - other)
        i, j, t, s = i[on], j[on], t[on], s[on]
        # both lines must get the same point, so it is always reckoned along the one that comes first
        f, p = np.where(i < j, i, j), np.where(i < j, t, s)
        for to, v in ((line, i), (at, t), (px, np.round(ux[f] + p * dx[f], digits)), (py, np.round(uy[f] + p * dy[f], digits))):
            to.append(v)
    line, at, px, py = (np.concatenate(c) for c in (line, at, px, py))
    order = np.lexsort((py, px, at, line))
    line, px, py = line[order], px[order], py[order]
    whole = (line[1:] == line[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1]))
    return line[:-1][whole], (px[:-1][whole], py[:-1][whole], px[1:][whole], py[1:][whole])


def arranged(e: Edges, group: np.ndarray, second: np.ndarray, digits: int) -> tuple[np.ndarray, Ends, dict[tuple[bool, bool], np.ndarray]]:
    """Group and ends of all edges after cutting, and by role and side (left: true) whether polygons cover it. group, second: of each row, a polygon."""
    real = (e.x1 != e.x2) | (e.y1 != e.y2)
    n_groups, row = int(group.max(initial=-1)) + 1, e.row[real]
    ahead, ends = _ordered(*(c[real] for c in (e.x1, e.y1, e.x2, e.y2)))
    first, line_of = _distinct(group[row], *ends)
    part_line, p = _cut(group[row][first], tuple(c[first] for c in ends), n_groups, digits)
    keeps, p = _ordered(*p)
    side_first, side_of = _distinct(group[row][first][part_line], *p)
    side, side_group = tuple(c[side_first] for c in p), group[row][first][part_line][side_first]
    # whose edge a side is: a polygon that runs there and back isn't beside it
    n_parts, at = _runs(part_line, len(first))
    keys, ways = [], []
    for i, j in spread(n_parts[line_of], at[line_of]):
        keys.append(side_of[j] * e.n + row[i])
        ways.append(np.where(ahead[i] == keeps[j], 1, -1))
    key, number = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_inverse=True)
    net = np.bincount(number, np.concatenate([*ways, np.empty(0, np.int64)]), len(key))
    owner, left = key[net != 0], net[net != 0] > 0
    covers = {}
    for role in (False, True):
        for way in (False, True):
            own = owner[(second[owner % e.n] == role) & (left == way)] // e.n if len(owner) else owner
            covers[role, way] = np.bincount(own, minlength=len(side_first)) > 0
    # whose inside holds a side's middle
    x, y = (side[0] + side[2]) / 2, (side[1] + side[3]) / 2
    box = e.bounds()
    by_group = np.argsort(group, kind="stable")
    count, start = _runs(group, n_groups)
    edge_count, edge_start = _runs(row, e.n)
    ux, uy, vx, vy = ends
    for i, j in spread(count[side_group], start[side_group]):
        j = by_group[j]
        near = (box[j, 0] <= x[i]) & (x[i] <= box[j, 2]) & (box[j, 1] <= y[i]) & (y[i] <= box[j, 3])
        i, j = i[near], j[near]
        mine = i * e.n + j
        place = np.minimum(np.searchsorted(owner, mine), max(len(owner) - 1, 0))
        other = owner[place] != mine if len(owner) else np.ones(len(i), bool)
        i, j = i[other], j[other]
        crossed = np.zeros(len(i), np.int64)
        for k, m in spread(edge_count[j], edge_start[j]):
            over = (uy[m] > y[i[k]]) != (vy[m] > y[i[k]])
            k, m = k[over], m[over]
            hit = x[i[k]] < (vx[m] - ux[m]) * (y[i[k]] - uy[m]) / (vy[m] - uy[m]) + ux[m]
            crossed += np.bincount(k[hit], minlength=len(i))
        inside = crossed % 2 == 1
        for role in (False, True):
            held = i[inside & (second[j] == role)]
            covers[role, False][held] = covers[role, True][held] = True
    return side_group, side, covers


def picked(group: np.ndarray, ends: Ends, covers: dict[tuple[bool, bool], np.ndarray], of_sides: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, Ends]:
    """Group and ends of the directed edges of each group's boundary among arranged ones, the result to the left."""
    is_left, is_right = (of_sides(covers[False, way], covers[True, way]) for way in (True, False))
    kept = is_left != is_right
    way = is_left[kept]
    ux, uy, vx, vy = (c[kept] for c in ends)
    return group[kept], tuple(np.where(way, a, b) for a, b in ((ux, vx), (uy, vy), (vx, ux), (vy, uy)))


def areas(group: np.ndarray, ends: Ends, n_groups: int) -> np.ndarray:
    """Area within each group's boundary, summed over edges from its lowest point."""
    x1, y1, x2, y2 = ends
    low = np.full(n_groups, np.inf)
    np.minimum.at(low, group, y1)
    return np.bincount(group, (x1 - x2) * ((y1 - low[group]) + (y2 - low[group])) / 2, n_groups).astype(float)  # integers if there are no edges
