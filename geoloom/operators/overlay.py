"""Unions, intersections and differences of groups of polygons, from their edges.

Groups of at most `PER_TASK` edges are worked on by `functions/arrangement.py`, many in a task, after one shuffle. The
boundary of larger ones is found in joins and groupings over edges; no task sees such a group's polygons together.
The steps are the same:

1. Vertices are rounded to `digits` decimals and polygons cut into directed edges, the inside to the left. For a
   union, an edge that polygons use in both directions is inside and cancels.
2. Edges of a group that meet are paired by cells, and cut where they cross, touch or overlap, so that afterwards two
   edges are the same or have no inner point in common.
3. Same edges are grouped; which sides of an edge are covered follows from the polygons that own it and from those
   that hold its middle. Edges with the result on one side only are its boundary.

`boundary` returns these edges; areas are sums over them, which `areas` reckons where the edges are. `overlay` chains a group's edges to rings, each group in one
task, as its result is one value. Polygons may overlap, repeat and have holes; those of a group are simple, with
shells counter-clockwise.

Null and empty geometries are left out; groups without any give no row. Nulls in `by` are a group of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrangement
from ..functions.arrangement import numbered
from ..functions.geometry import contains_point, envelope, point_struct
from ..functions.polygons import edges_of
from ..sources.files import ranges_of, saved
from .spatial import candidate_pairs

#: Groups of up to so many edges are worked on in one task, and as many groups together as have about `AT_ONCE` edges.
PER_TASK = 512
AT_ONCE = 8192

#: What belongs to the result, from whether first and second polygons cover a side.
RESULTS: dict[str, Callable[[Column, Column], Column]] = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "first": lambda a, b: a,
    "rest": lambda a, b: b & ~a,
}
_ENDS = ["ux", "uy", "vx", "vy"]


def _shapes(df: DataFrame, by: list[str], second: bool, digits: int) -> DataFrame:
    """g, second, geom with rounded vertices."""
    snap = lambda p: point_struct(F.round(p.x, digits), F.round(p.y, digits))
    geom = F.struct(F.transform("geom.rings", lambda r: F.transform(r, snap)).alias("rings"), F.col("geom.srid").alias("srid"))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("none"))
    return df.where("size(geom.rings) > 0").select(group.alias("g"), F.lit(second).alias("second"), geom.alias("geom"))


def _identified(shapes: DataFrame) -> DataFrame:
    """With pid; equal shapes of a group once."""
    pid = F.concat_ws("-", F.xxhash64("geom"), F.xxhash64(F.lit(1), "geom"))
    return shapes.withColumn("pid", pid).dropDuplicates(["g", "second", "pid"])


def _ordered(p: Column, q: Column, same: Column) -> list[Column]:
    """The ends of an edge in order, and whether it still runs that way."""
    keeps = (p.x < q.x) | ((p.x == q.x) & (p.y < q.y))
    u, v = (F.when(keeps, a).otherwise(b) for a, b in ((p, q), (q, p)))
    return [u.x.alias("ux"), u.y.alias("uy"), v.x.alias("vx"), v.y.alias("vy"), F.when(keeps, same).otherwise(~same).alias("forward")]


def _edges(shapes: DataFrame) -> DataFrame:
    """g, second, pid, forward and ends of each edge; forward: the inside is to the left of u to v."""
    pairs = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(F.get(r, i).alias("p"), F.get(r, i + 1).alias("q")))
    rings = shapes.select("g", "second", "pid", F.explode("geom.rings").alias("r")).where("size(r) > 3")
    rows = rings.select("g", "second", "pid", F.explode(pairs(F.col("r"))).alias("e")).where("e.p != e.q")
    return rows.select("g", "second", "pid", *_ordered(F.col("e.p"), F.col("e.q"), F.lit(True)))


def _boxed(df: DataFrame) -> DataFrame:
    return df.withColumns({"minx": F.least("ux", "vx"), "maxx": F.greatest("ux", "vx"), "miny": F.least("uy", "vy"), "maxy": F.greatest("uy", "vy")})


def _cuts(lines: DataFrame, cell: float, digits: int) -> DataFrame:
    """g, ends, cuts: the points at which lines are to be cut, in order from u to v; lines without any are left out."""
    near = 10.0**-digits
    pairs = candidate_pairs(_boxed(lines), _boxed(lines), cell=cell, on=["g"])
    c = {(s, k): F.col(f"{s}.{k}") for s in "lr" for k in _ENDS}
    apart = F.lit(False)
    for k in _ENDS:
        apart = apart | (c["l", k] != c["r", k])
    dx, dy = c["l", "vx"] - c["l", "ux"], c["l", "vy"] - c["l", "uy"]
    ex, ey = c["r", "vx"] - c["r", "ux"], c["r", "vy"] - c["r", "uy"]
    length = F.hypot(dx, dy)

    def touch(x: Column, y: Column) -> Column:
        """The end (x, y) of the other line, if it lies on this one."""
        wx, wy = x - c["l", "ux"], y - c["l", "uy"]
        t = (wx * dx + wy * dy) / (length * length)
        on = (F.abs(dx * wy - dy * wx) <= near * length) & (t > 0) & (t < 1)
        not_end = ((x != c["l", "ux"]) | (y != c["l", "uy"])) & ((x != c["l", "vx"]) | (y != c["l", "vy"]))
        return F.when(on & not_end, F.struct(t.alias("t"), x.alias("x"), y.alias("y")))

    wx, wy = c["r", "ux"] - c["l", "ux"], c["r", "uy"] - c["l", "uy"]
    turn = dx * ey - dy * ex
    t, s = F.try_divide(wx * ey - wy * ex, turn), F.try_divide(wx * dy - wy * dx, turn)
    reach, other = near / length, near / F.hypot(ex, ey)
    # both lines must get the same point, so it is always reckoned along the one that comes first
    first = F.struct(*(c["l", k] for k in _ENDS)) < F.struct(*(c["r", k] for k in _ENDS))
    at = lambda o, d, p, e: F.round(F.when(first, c["l", o] + t * d).otherwise(c["r", p] + s * e), digits)
    cross = F.when((t > reach) & (t < 1 - reach) & (s > other) & (s < 1 - other), F.struct(t.alias("t"), at("ux", dx, "ux", ex).alias("x"), at("uy", dy, "uy", ey).alias("y")))
    points = F.array(touch(c["r", "ux"], c["r", "uy"]), touch(c["r", "vx"], c["r", "vy"]), cross)
    found = pairs.where(apart).select(F.col("l.g").alias("g"), *(c["l", k].alias(k) for k in _ENDS), F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p"))
    return found.groupBy("g", *_ENDS).agg(F.transform(F.array_sort(F.collect_set("p")), lambda p: point_struct(p.x, p.y)).alias("cuts"))


def boundary(polygons: DataFrame, by: list[str] = (), *, cell: float, other: DataFrame | None = None, result: str = "union", digits: int = 9) -> DataFrame:
    """by, x1, y1, x2, y2: directed edges of the boundary, the result to the left.

    polygons, other: by and geom. cell: about the length of edges. result: see RESULTS; without `other` the union.
    """
    by = list(by)
    small, large = _by_size(polygons, by, other, digits)
    found = _of_small_groups(small, by, {"": result}, digits)
    return found if large is None else found.unionByName(_of_large_groups(large, by, cell, result, digits))


def areas(polygons: DataFrame, by: list[str] = (), *, cell: float, results: dict[str, str], other: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """by and a column per name in results: the area of that result (see RESULTS), zero where nothing is left; a row per group with polygons.

    Edges of smaller groups are cut once for all results and their areas summed in the same task, so that no edge is shuffled.
    """
    by = list(by)
    small, large = _by_size(polygons, by, other, digits)
    found = _of_small_groups(small, by, results, digits, sums=True)
    if large is None:
        return found
    keys = [F.col(f"g.{k}").alias(k) for k in by]
    parts = [found, large.select("g").distinct().select(*keys, *(F.lit(0.0).alias(n) for n in results))]
    for name, result in results.items():
        size = boundary_area(_of_large_groups(large, by, cell, result, digits), by, "__area")
        parts.append(size.select(*by, *((F.col("__area") if n == name else F.lit(0.0)).alias(n) for n in results)))
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(*(F.sum(n).alias(n) for n in results))


def _by_size(polygons: DataFrame, by: list[str], other: DataFrame | None, digits: int) -> tuple[DataFrame, DataFrame | None]:
    """Shapes of groups of at most PER_TASK edges, and of larger ones, if there are any."""
    shapes = _shapes(polygons, by, False, digits)
    if other is not None:
        shapes = shapes.unionByName(_shapes(other, by, True, digits))
    shapes = saved(shapes, "shapes")
    n = F.aggregate("geom.rings", F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    sizes = shapes.groupBy("g").agg(F.sum(n).alias("n"))
    crowded = saved(sizes.where(F.col("n") > PER_TASK).select("g"), "crowded")
    if crowded.isEmpty():
        return shapes, None
    return shapes.join(crowded, "g", "left_anti"), shapes.join(crowded, "g", "left_semi")


def _of_small_groups(shapes: DataFrame, by: list[str], results: dict[str, str], digits: int, sums: bool = False) -> DataFrame:
    """by and the boundary's edges of the one result, or with `sums` a row per group with the area of each."""
    total = shapes.agg(F.sum(F.aggregate("geom.rings", F.lit(0).cast("long"), lambda a, r: a + F.size(r)))).first()[0] or 0
    names = [f"k{i}" for i in range(len(by))]
    bucket = F.pmod(F.xxhash64("g"), F.lit(total // AT_ONCE + 1)).alias("bucket")
    rows = shapes.select(bucket, *(F.col(f"g.{k}").alias(n) for k, n in zip(by, names)), "second", "geom")
    out = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    columns = [f"a{i}" for i in range(len(results))] if sums else ["x1", "y1", "x2", "y2"]

    def of_bucket(table: pa.Table) -> pa.Table:
        first, group = numbered(table, names)
        second = table.column("second").to_numpy()
        cut = arrangement.arranged(edges_of(table.column("geom").combine_chunks()), group, second, digits)
        found = [arrangement.picked(*cut, RESULTS[r]) for r in results.values()]
        if sums:
            of, values = np.arange(len(first)), [arrangement.areas(*f, len(first)) for f in found]
        else:
            ((of, values),) = found
        at = pa.array(first[of])
        return pa.table([*(table.column(n).take(at) for n in names), *map(pa.array, values)], [*names, *columns])

    found = rows.groupBy("bucket").applyInArrow(of_bucket, out + ", ".join(f"{c} double" for c in columns))
    return found.withColumnsRenamed(dict(zip(names, by)) | (dict(zip(columns, results)) if sums else {}))


def _of_large_groups(shapes: DataFrame, by: list[str], cell: float, result: str, digits: int) -> DataFrame:
    shapes = saved(_identified(shapes), "shapes")
    edges = saved(_edges(shapes), "edges")
    lines = edges.groupBy("g", *_ENDS).agg(F.max("forward").alias("plus"), F.max(~F.col("forward")).alias("minus"))
    if result == "union":
        lines = lines.where(~(F.col("plus") & F.col("minus")))
    lines = saved(lines.drop("plus", "minus"), "lines")
    cut = lines.join(_cuts(lines, cell, digits), ["g", *_ENDS], "left")
    u, v = (point_struct(F.col(f"{k}x"), F.col(f"{k}y")) for k in "uv")
    stops = cut.select("g", *_ENDS, F.concat(F.array(u), F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>")), F.array(v)).alias("s"))
    steps = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("p"), F.get("s", i + 1).alias("q")))
    parts = stops.select("g", *_ENDS, F.explode(steps).alias("e")).where("e.p != e.q")
    owned = edges.join(parts, ["g", *_ENDS]).select("g", "second", "pid", *_ordered(F.col("e.p"), F.col("e.q"), F.col("forward")))
    # a polygon that runs along an edge there and back isn't beside it
    net = owned.groupBy("g", *_ENDS, "second", "pid").agg(F.sum(F.when(F.col("forward"), 1).otherwise(-1)).alias("net")).where("net <> 0")
    owned = saved(net.select("g", *_ENDS, "second", "pid", (F.col("net") > 0).alias("forward")), "owned")

    side = lambda second, c: F.max(F.when(F.col("second") == second, c).otherwise(F.lit(False)))
    sides = owned.groupBy("g", *_ENDS).agg(
        side(False, F.col("forward")).alias("a_left"), side(False, ~F.col("forward")).alias("a_right"), side(True, F.col("forward")).alias("b_left"), side(True, ~F.col("forward")).alias("b_right")
    )
    if result == "union":
        sides = sides.where(~((F.col("a_left") | F.col("b_left")) & (F.col("a_right") | F.col("b_right"))))
    sides = saved(sides, "sides")
    mid = {"x": (F.col("ux") + F.col("vx")) / 2, "y": (F.col("uy") + F.col("vy")) / 2}
    middles = sides.select("g", *_ENDS, *(mid[a].alias(f"{m}{a}") for a in "xy" for m in ("min", "max")))
    held_by = shapes.select("g", "second", "pid", "geom", *(c.alias(k) for k, c in envelope(F.col("geom")).items()))
    pairs = candidate_pairs(middles, held_by, cell=cell, on=["g"])
    inside = pairs.where(contains_point(F.col("r.geom"), F.col("l.minx"), F.col("l.miny"))).select(F.col("l.g").alias("g"), *(F.col(f"l.{k}").alias(k) for k in _ENDS), F.col("r.second").alias("second"), F.col("r.pid").alias("pid"))
    inside = inside.join(owned.select("g", *_ENDS, "second", "pid"), ["g", *_ENDS, "second", "pid"], "left_anti")
    held = inside.groupBy("g", *_ENDS).agg(F.max(~F.col("second")).alias("a_in"), F.max("second").alias("b_in"))
    found = sides.join(held, ["g", *_ENDS], "left")
    covered = lambda role, at: F.col(f"{role}_{at}") | F.coalesce(f"{role}_in", F.lit(False))
    left, right = (RESULTS[result](covered("a", at), covered("b", at)) for at in ("left", "right"))
    kept = found.withColumns({"__left": left, "__right": right}).where("__left != __right")
    way = lambda a, b: F.when(F.col("__left"), F.col(a)).otherwise(F.col(b))
    return kept.select(*(F.col(f"g.{k}").alias(k) for k in by), way("ux", "vx").alias("x1"), way("uy", "vy").alias("y1"), way("vx", "ux").alias("x2"), way("vy", "uy").alias("y2"))


def boundary_area(edges: DataFrame, by: list[str] = (), area: str = "area") -> DataFrame:
    """by and the area within a boundary, summed over edges from each group's lowest point."""
    by = list(by)
    term = lambda low: (F.col("x1") - F.col("x2")) * ((F.col("y1") - low) + (F.col("y2") - low)) / 2
    if not by:
        low = edges.agg(F.min("y1").alias("__low")).where("__low IS NOT NULL")  # one row
        return edges.join(F.broadcast(low)).agg(F.coalesce(F.sum(term(F.col("__low"))), F.lit(0.0)).alias(area))
    low = edges.groupBy(*(F.col(k).alias(f"__{k}") for k in by)).agg(F.min("y1").alias("__low"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return edges.join(low, same).groupBy(*by).agg(F.sum(term(F.col("__low"))).alias(area))


def _next_edges(tail: np.ndarray, head: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """For each edge the one that follows it; where several leave a vertex, the first one clockwise from where it came, so that rings only touch. -1: none."""
    order = np.argsort(tail, kind="stable")
    first, last = np.searchsorted(tail[order], head, "left"), np.searchsorted(tail[order], head, "right")
    following = np.where(last > first, order[np.minimum(first, len(order) - 1)], -1)
    for e in np.flatnonzero(last - first > 1):
        out = order[first[e] : last[e]]
        turn = (angle[e] + np.pi - angle[out]) % (2 * np.pi)
        following[e] = out[np.argmin(np.where(turn < 1e-12, 2 * np.pi, turn))]
    return following


def _rings_of(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, straight: float) -> list[np.ndarray]:
    """Closed rings of directed edges, without vertices on straight lines; an open chain, which rounding can leave, is closed."""
    vertex, place = np.unique(np.concatenate([x1 + 1j * y1, x2 + 1j * y2]), return_inverse=True)
    tail, head = place[: len(x1)], place[len(x1) :]
    follow = _next_edges(tail, head, np.arctan2(y2 - y1, x2 - x1)).tolist()
    no_way_in = np.ones(len(x1), bool)
    no_way_in[[f for f in follow if f >= 0]] = False
    seen, rings = [False] * len(x1), []
    for start in [*np.flatnonzero(no_way_in).tolist(), *range(len(x1))]:
        chain, e = [], start
        while e >= 0 and not seen[e]:
            seen[e] = True
            chain.append(e)
            e = follow[e]
        if len(chain) > 2:
            z = vertex[tail[chain]]
            d0, d1 = z - np.roll(z, 1), np.roll(z, -1) - z
            bend = np.abs((np.conj(d0) * d1).imag) > straight * np.maximum(np.abs(d0), np.abs(d1))
            z = z[bend]
            if len(z) > 2:
                rings.append(np.append(z, z[0]))
    return rings


def _area(z: np.ndarray) -> float:
    w = z - z[0]
    return float((np.conj(w[:-1]) * w[1:]).imag.sum() / 2)


def _has(ring: np.ndarray, at: complex) -> bool:
    p, q = ring[:-1], ring[1:]
    span = (p.imag > at.imag) != (q.imag > at.imag)
    p, q = p[span], q[span]
    return bool(np.count_nonzero(at.real < (q.real - p.real) * (at.imag - p.imag) / (q.imag - p.imag) + p.real) % 2)


def _in_parts(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Shells, largest first, each with the holes in it."""
    shells = sorted((r for r in rings if _area(r) > 0), key=lambda r: (-_area(r), r[0].real, r[0].imag))
    parts = [[r] for r in shells]
    for hole in (r for r in rings if _area(r) < 0):
        at = (hole[0] + hole[1]) / 2
        holders = [k for k, s in enumerate(shells) if _has(s, at)]
        if holders:
            parts[holders[-1]].append(hole)  # the smallest shell around it
    return parts


def chained(edges: DataFrame, by: list[str], *, srid: int = 4326, digits: int = 9, parts: bool = False) -> DataFrame:
    """by and geom: the rings of directed edges; parts: a row per shell with its holes, numbered from 0 by `part`, largest first."""
    by = list(by)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.struct([("rings", pa.list_(pa.list_(point))), ("srid", pa.int32())])
    keys = edges.select(*by).schema if by else None

    def of_groups(table: pa.Table) -> pa.Table:
        first, number = numbered(table, by)
        order = np.argsort(number, kind="stable")
        ends = [table.column(c).to_numpy()[order] for c in ("x1", "y1", "x2", "y2")]
        stops = np.searchsorted(number[order], np.arange(len(first) + 1))
        at, part, shapes = [], [], []
        as_rings = lambda rs: {"rings": [[{"x": v.real, "y": v.imag} for v in r.tolist()] for r in rs], "srid": srid}
        for k, row in enumerate(first.tolist()):
            found = _in_parts(_rings_of(*(c[stops[k] : stops[k + 1]] for c in ends), 10.0**-digits))
            own = found if parts else [[r for p in found for r in p]]
            at += [row] * len(own)
            part += range(len(own))
            shapes += map(as_rings, own)
        cols = [table.column(k).take(pa.array(at, pa.int64())) for k in by]
        return pa.table([*cols, pa.array(part, pa.int32()), pa.array(shapes, kind)], [*by, "part", "geom"])

    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys) if by else ""
    # groups go by buckets, several of them to a partition, as a call for each small group would cost more than its rings
    bucket = F.pmod(F.xxhash64(*by), F.lit(16 * ranges_of(edges, None))) if by else F.lit(0)
    out = edges.withColumn("__bucket", bucket).groupBy("__bucket").applyInArrow(of_groups, f"{names}part int, geom struct<rings:array<array<struct<x:double,y:double>>>,srid:int>")
    return out if parts else out.drop("part")


def overlay(polygons: DataFrame, by: list[str] = (), *, cell: float, other: DataFrame | None = None, result: str = "union", digits: int = 9, srid: int = 4326, parts: bool = False) -> DataFrame:
    """by, geom: the union of each group's polygons, or what they have in common with, or apart from, those of `other`. See `boundary` and `chained`."""
    return chained(boundary(polygons, by, cell=cell, other=other, result=result, digits=digits), by, srid=srid, digits=digits, parts=parts)
