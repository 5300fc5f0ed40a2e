import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.functions import wkt

from .test_geometry import L_SHAPE, RING, poly, rect

TWO = poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)], [(9, 9), (10, 9), (10, 10), (9, 9)])


def test_written_and_read():
    assert wkt.written(rect(0, 0, 1, 2.5)) == "POLYGON ((0 0, 1 0, 1 2.5, 0 2.5, 0 0))"
    assert wkt.written(TWO) == "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1)), ((9 9, 10 9, 10 10, 9 9)))"
    assert wkt.written(poly()) == "POLYGON EMPTY" and wkt.written(None) is None
    for shape in (L_SHAPE, RING, TWO, poly()):
        assert wkt.parsed(wkt.written(shape)) == shape
    turned = wkt.parsed("srid=3857; multipolygon z (((0 0 5, 0 4 5, 4 4 5, 4 0 5, 0 0 5),(1 1 5, 3 1 5, 3 3 5, 1 3 5, 1 1 5)))")
    assert turned["srid"] == 3857 and g.overlap(turned, RING) == pytest.approx(12)
    for bad in (None, "", "POINT (1 2)", "POLYGON ((0 0, 1 1", "POLYGON ((0 0, 1 x, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0)) 5", "POLYGON ((0, 1 0, 1 1, 0 0))", "POLYGONS ((0 0))"):
        assert wkt.parsed(bad) is None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=3, max_size=9))
def test_numbers_survive(points):
    ring = [{"x": x, "y": y} for x, y in [*points, points[0]]]
    back = wkt.parsed(wkt.written({"rings": [ring], "srid": 4326}))["rings"][0]
    assert back in (ring, ring[::-1])


def test_columns(spark):
    shapes = [L_SHAPE, RING, TWO, poly(), None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"i int, geom {g.GEOMETRY}")
    rows = {r.i: r for r in df.select("i", wkt.geometry_type(F.col("geom")).alias("t"), wkt.to_wkt("geom").alias("w")).collect()}
    assert [rows[i].t for i in range(5)] == ["POLYGON", "POLYGON", "MULTIPOLYGON", "POLYGON", None] and rows[4].w is None
    back = df.select("i", "geom", wkt.from_wkt(wkt.to_wkt("geom")).alias("b")).where("geom IS NOT NULL").collect()
    assert all(r.b == r.geom for r in back)
    # rings of unlike lengths go through all codecs
    again = df.select("geom", g.from_wkb(g.to_wkb("geom")).alias("b"), g.point_on_surface("geom").alias("p")).collect()
    assert all(r.geom is None and r.b.rings is None or r.b == r.geom or not r.geom.rings for r in again)
    assert [r.p.x is None for r in again].count(True) == 2


INVALID = {
    "edges meet": [
        poly([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]),  # a bow tie
        poly([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]),  # touches its own edge
        poly([(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4), (0, 0)]),  # a spike
        poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(3, 1), (3, 3), (5, 3), (5, 1), (3, 1)]),  # a hole across the border
        poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 1), (0, 3), (3, 3), (3, 1), (0, 1)]),  # a hole along the border
        poly([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]),  # parts that overlap
    ],
    "rings nested wrongly": [
        poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(9, 9), (9, 10), (10, 10), (10, 9), (9, 9)]),
        poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]),
    ],
    "not closed": [poly([(0, 0), (2, 0), (2, 2), (0, 2)])],
    "too few points": [poly([(0, 0), (2, 0), (0, 0)]), poly([(0, 0), (4, 0), (4, 4), (0, 0)], [])],
    "not finite": [poly([(0, 0), (math.nan, 0), (2, 2), (0, 0)]), poly([(0, 0), (math.inf, 0), (2, 2), (0, 0)])],
    "repeated point": [poly([(0, 0), (2, 0), (2, 0), (2, 2), (0, 0)])],
}
VALID = [
    L_SHAPE, RING, TWO, poly(), rect(0, 0, 1, 1), poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 2), (1, 3), (2, 2), (1, 1), (0, 2)]),  # a hole that touches the border
    poly([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]),  # parts that touch
    poly([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (1, 8), (8, 8), (8, 1), (1, 1)], [(2, 2), (7, 2), (7, 7), (2, 7), (2, 2)]),  # an island in a hole
]


def test_validity(spark):
    rows = [(why, s) for why, shapes in INVALID.items() for s in shapes] + [("valid", s) for s in VALID] + [("null", None)]
    df = spark.createDataFrame([(i, w, s) for i, (w, s) in enumerate(rows)], f"i int, want string, geom {g.GEOMETRY}").repartition(2)
    got = {r.i: (r.want, r.why, r.ok) for r in df.select("i", "want", wkt.invalid_reason("geom").alias("why"), wkt.is_valid(F.col("geom")).alias("ok")).collect()}
    for want, why, ok in got.values():
        assert (want, None if want in ("valid", "null") else want) == (want, why) and ok == (None if want == "null" else want == "valid")


def test_a_long_ring(spark):
    n = 3000
    circle = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    knot = [*circle[:1000], (0.0, -2.0), *circle[1000:]]
    df = spark.createDataFrame([("ok", poly([*circle, circle[0]])), ("knot", poly([*knot, knot[0]]))], f"k string, geom {g.GEOMETRY}")
    assert {r.k: r.w for r in df.select("k", wkt.invalid_reason("geom").alias("w")).collect()} == {"ok": None, "knot": "edges meet"}


def test_one_file_is_worked_on_by_many_tasks(spark, data):
    from geoloom import shape_queries

    assert shape_queries.wkt_shapes(spark, data).rdd.getNumPartitions() >= 4
