"""Geometry as plain columns.

A geometry is struct<rings: array<array<struct<x: double, y: double>>>, srid: int>. Shells run
counter-clockwise and holes clockwise, so signed sums over rings need no nesting; a multipolygon is the
rings of all its parts. x is longitude, y latitude. A null geometry gives null, one without rings area 0.

All but the functions on two general polygons are Column expressions. Those are in `polygons`, Arrow UDFs for the
pairs that are left after a join on cells and boxes.
"""

from __future__ import annotations

import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .polygons import contains, equals, intersects, overlap_area, within  # noqa: F401

GEOMETRY = "struct<rings:array<array<struct<x:double,y:double>>>,srid:int>"
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_GEOMETRY = T.StructType([T.StructField("rings", T.ArrayType(T.ArrayType(_POINT))), T.StructField("srid", T.IntegerType())])
EARTH_RADIUS_M = 6_371_008.8
MERCATOR_RADIUS_M = 6_378_137.0


def point_struct(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column, srid: int = 4326) -> Column:
    """The rectangle as a geometry."""
    ring = F.array(point_struct(minx, miny), point_struct(maxx, miny), point_struct(maxx, maxy), point_struct(minx, maxy), point_struct(minx, miny))
    return F.struct(F.array(ring).alias("rings"), F.lit(srid).alias("srid"))


def envelope(geom: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy of a geometry."""
    points = F.flatten(geom["rings"])
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def _over_edges(ring: Column, term) -> Column:
    """Sum of term(p, q) over the edges of a ring."""
    numbers = F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0)))
    terms = F.transform(numbers, lambda i: F.coalesce(term(F.get(ring, i), F.get(ring, i + 1)), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def _over_rings(geom: Column, term) -> Column:
    return F.aggregate(F.transform(geom["rings"], lambda r: _over_edges(r, term)), F.lit(0.0), lambda a, t: a + t)


def signed_area(geom: Column) -> Column:
    """Measured from each ring's first vertex, so that small shapes far from the origin keep their digits."""

    def of_ring(ring: Column) -> Column:
        o = F.get(ring, 0)
        return _over_edges(ring, lambda p, q: ((p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)) / 2)

    return F.aggregate(F.transform(geom["rings"], of_ring), F.lit(0.0), lambda a, t: a + t)


def perimeter(geom: Column) -> Column:
    """Length of all rings."""
    return _over_rings(geom, lambda p, q: F.hypot(q.x - p.x, q.y - p.y))


def area(geom: Column) -> Column:
    """Area in squared units of the coordinates, holes left out."""
    return F.abs(signed_area(geom))


def centroid(geom: Column) -> Column:
    """Area-weighted centre as struct<x, y>; null without area."""
    whole = signed_area(geom) * 6
    x = _over_rings(geom, lambda p, q: (p.x + q.x) * (p.x * q.y - q.x * p.y))
    y = _over_rings(geom, lambda p, q: (p.y + q.y) * (p.x * q.y - q.x * p.y))
    return F.when(whole != 0, F.struct((x / whole).alias("x"), (y / whole).alias("y")))


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a point on a left or lower edge is inside, on a right or upper one outside, so tilings assign it once."""

    def crosses(p: Column, q: Column) -> Column:
        return F.when(((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / (q.y - p.y) + p.x), 1.0).otherwise(0.0)

    return _over_rings(geom, crosses) % 2 == 1


def bbox_overlaps(a: str, b: str) -> Column:
    """Boxes of the aliases a and b share a point."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "minx") <= c(b, "maxx")) & (c(b, "minx") <= c(a, "maxx")) & (c(a, "miny") <= c(b, "maxy")) & (c(b, "miny") <= c(a, "maxy"))


def bbox_overlap_area(a: str, b: str) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.least(c(a, "maxx"), c(b, "maxx")) - F.greatest(c(a, "minx"), c(b, "minx"))
    h = F.least(c(a, "maxy"), c(b, "maxy")) - F.greatest(c(a, "miny"), c(b, "miny"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_RADIUS_M, F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS_M), F.degrees(F.atan(F.exp(y / MERCATOR_RADIUS_M)) * 2 - F.lit(np.pi / 2))


def to_utm(lon: Column, lat: Column, zone: int = 19) -> tuple[Column, Column]:
    """Easting and northing on the northern half, by Krueger's series to the third order of the flattening (WGS84)."""
    f, a = 1 / 298.257223563, 6_378_137.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    k = 2 * np.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * k) * k)
    along = F.radians(lon - F.lit(float(zone * 6 - 183)))
    xi, eta = F.atan2(t, F.cos(along)), F.atanh(F.sin(along) / F.sqrt(t * t + 1))
    north, east = xi, eta
    for j, c in enumerate(alpha, 1):
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c
    return east * (0.9996 * radius) + 500_000.0, north * (0.9996 * radius)


def projected(geom: Column, to=to_mercator, srid: int = 3857) -> Column:
    """The geometry with each vertex projected."""

    def move(p: Column) -> Column:
        x, y = to(p.x, p.y)
        return point_struct(x, y)

    return F.struct(F.transform(geom["rings"], lambda r: F.transform(r, move)).alias("rings"), F.lit(srid).alias("srid"))


def hilbert_key(x: Column, y: Column, bounds: tuple[float, float, float, float], bits: int = 16) -> Column:
    """Place of a point on a Hilbert curve over bounds (minx, miny, maxx, maxy), of 2 ** bits steps each way; near places are mostly near each other. Points outside count as on the border."""
    side = 1 << bits

    def step(c: Column, low: float, high: float) -> Column:
        at = F.floor((c - low) * (side / (high - low))) if high > low else c * 0
        return F.least(F.greatest(at, F.lit(0)), F.lit(side - 1)).cast("long")

    start = F.struct(step(x, bounds[0], bounds[2]).alias("x"), step(y, bounds[1], bounds[3]).alias("y"), F.lit(0).cast("long").alias("d"))

    def quarter(a: Column, s: Column) -> Column:
        right, upper = (a.x.bitwiseAND(s) > 0).cast("long"), (a.y.bitwiseAND(s) > 0).cast("long")
        turned = lambda c: F.when(right == 1, F.lit(side - 1) - c).otherwise(c)
        nx, ny = F.when(upper == 0, turned(a.y)).otherwise(a.x), F.when(upper == 0, turned(a.x)).otherwise(a.y)
        return F.struct(nx.alias("x"), ny.alias("y"), (a.d + s * s * (right * 3).bitwiseXOR(upper)).alias("d"))

    sizes = F.array(*(F.lit(1 << b).cast("long") for b in reversed(range(bits))))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(sizes, start, quarter, lambda a: a.d))


def hex_size_m(area_m2: float) -> float:
    """Edge of a regular hexagon of this area."""
    return float(np.sqrt(2 * area_m2 / (3 * np.sqrt(3))))


def hex_cell(x_m: Column, y_m: Column, edge_m: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the pointy-top hexagon that holds a point in metres."""
    q = (x_m * float(np.sqrt(3) / 3) - y_m / 3) / edge_m
    r = y_m * (2 / 3) / edge_m
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).otherwise(F.when(dr > ds, -rq - rs).otherwise(rr))
    return fq.cast("long"), fr.cast("long")


def hex_centre(q: Column, r: Column, edge_m: float) -> tuple[Column, Column]:
    return (q + r / 2) * (float(np.sqrt(3)) * edge_m), r * (1.5 * edge_m)


def hex_boundary(q: Column, r: Column, edge_m: float, srid: int = 32619) -> Column:
    """The cell as a polygon, from its lower right corner on."""
    x, y = hex_centre(q, r, edge_m)
    half = float(np.sqrt(3) / 2) * edge_m
    corners = [(half, -edge_m / 2), (half, edge_m / 2), (0.0, edge_m), (-half, edge_m / 2), (-half, -edge_m / 2), (0.0, -edge_m)]
    ring = F.array(*(point_struct(x + dx, y + dy) for dx, dy in [*corners, corners[0]]))
    return F.struct(F.array(ring).alias("rings"), F.lit(srid).alias("srid"))


def hex_cover(geom: Column, edge_m: float) -> Column:
    """Array of the cells (q, r) whose centre lies in a polygon in metres, row by row: the centres between two crossings of its edges. Left borders count, right ones don't."""
    tall, wide = 1.5 * edge_m, float(np.sqrt(3)) * edge_m
    ys = F.transform(F.flatten(geom["rings"]), lambda p: p.y)
    rows = F.filter(F.sequence(F.ceil(F.array_min(ys) / tall), F.ceil(F.array_max(ys) / tall)), lambda r: r * tall < F.array_max(ys))

    def crossings(y: Column) -> Column:
        def of_ring(ring: Column) -> Column:
            def cross(i: Column) -> Column:
                p, q = F.get(ring, i), F.get(ring, i + 1)
                return F.when((p.y > y) != (q.y > y), p.x + (q.x - p.x) * (y - p.y) / (q.y - p.y))

            return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), cross), lambda x: x.isNotNull())

        return F.array_sort(F.flatten(F.transform(geom["rings"], of_ring)))

    def in_row(r: Column) -> Column:
        def spans(xs: Column) -> Column:
            def between(k: Column) -> Column:
                start, end = F.ceil(F.get(xs, 2 * k) / wide - r / 2), F.ceil(F.get(xs, 2 * k + 1) / wide - r / 2) - 1
                return F.transform(F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>")), lambda q: F.struct(q.alias("q"), r.alias("r")))

            pairs = F.floor(F.size(xs) / 2)
            return F.flatten(F.transform(F.when(pairs > 0, F.sequence(F.lit(0).cast("long"), pairs - 1)).otherwise(F.array().cast("array<bigint>")), between))

        return F.element_at(F.transform(F.array(crossings(r * tall)), spans), 1)

    return F.flatten(F.transform(rows, in_row))


def _null(geom) -> bool:
    return geom is None or geom["rings"] is None


def _rings(geom) -> list[np.ndarray]:
    if _null(geom):
        return []
    return [np.array([(p["x"], p["y"]) for p in ring], float) for ring in geom["rings"] if ring is not None and len(ring) > 3]


_ARROW = pa.struct([("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), ("srid", pa.int32())])


def geometries(found: list[dict | None]) -> pa.Array:
    """Geometries given as dicts as an Arrow array; None is a geometry of nulls."""
    return pa.array([x or {"rings": None, "srid": None} for x in found], _ARROW)


def overlap(a: dict | None, b: dict | None) -> float | None:
    """Intersection area of two geometries given as dicts."""
    return overlap_area.func(geometries([a]), geometries([b]))[0].as_py()


def _meet(a: dict | None, b: dict | None) -> bool | None:
    return intersects.func(geometries([a]), geometries([b]))[0].as_py()


def _surface_point(geom) -> tuple[float, float] | None:
    rings = _rings(geom)
    if not rings:
        return None
    ys = sorted({y for r in rings for _, y in r})
    middle = (ys[0] + ys[-1]) / 2
    for y in sorted(((a + b) / 2 for a, b in pairwise(ys)), key=lambda y: (abs(y - middle), y)):  # parts can leave some rows empty
        xs = sorted((q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for r in rings for p, q in pairwise(r) if (p[1] > y) != (q[1] > y))
        width, x = max(((b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2])), default=(0, None))
        if x is not None and width > 0:
            return x, y
    return None


@F.arrow_udf(_POINT)
def point_on_surface(geom: pa.Array) -> pa.Array:
    """A point inside: the middle of the widest span of a scan line near half height."""
    found = [_surface_point(x) or (None, None) for x in geom.to_pylist()]
    return pa.array([{"x": x, "y": y} for x, y in found], pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def encode_wkb(geom) -> bytes | None:
    if _null(geom):
        return None
    rings = [[(p["x"], p["y"]) for p in r] for r in geom["rings"]]
    turn = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in pairwise(r))
    parts: list[list] = []
    for r in rings:
        if turn(r) >= 0 or not parts:
            parts.append([])
        parts[-1].append(r)
    body = [struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *v) for v in r) for r in p) for p in parts]
    return body[0] if len(body) == 1 else struct.pack("<BII", 1, 6, len(body)) + b"".join(body)


def decode_wkb(data: bytes | None, srid: int = 4326) -> dict | None:
    """Polygons and multipolygons of either byte order; shells turned counter-clockwise, holes clockwise; others give null."""
    if data is None:
        return None
    rings: list = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        kind, n = struct.unpack_from(order + "II", data, at + 1)
        at += 9
        if kind == 6:
            for _ in range(n):
                at = read(at)
        elif kind == 3:
            for i in range(n):
                (m,) = struct.unpack_from(order + "I", data, at)
                flat = struct.unpack_from(f"{order}{2 * m}d", data, at + 4)
                ring = list(zip(flat[::2], flat[1::2]))
                if (sum(p[0] * q[1] - q[0] * p[1] for p, q in pairwise(ring)) < 0) == (i == 0):
                    ring.reverse()
                rings.append([{"x": x, "y": y} for x, y in ring])
                at += 4 + 16 * m
        else:
            raise ValueError(kind)
        return at

    try:
        read(0)
    except (ValueError, struct.error, IndexError):
        return None
    return {"rings": rings, "srid": srid}


@F.arrow_udf(T.BinaryType())
def to_wkb(geom: pa.Array) -> pa.Array:
    return pa.array([encode_wkb(x) for x in geom.to_pylist()], pa.binary())


@F.arrow_udf(_GEOMETRY)
def from_wkb(data: pa.Array) -> pa.Array:
    return geometries([decode_wkb(x) for x in data.to_pylist()])
