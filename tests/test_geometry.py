import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import spatial, statistics


def poly(*rings):
    return {"rings": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings], "srid": 4326}


def rect(a, b, c, d):
    return poly([(a, b), (c, b), (c, d), (a, d), (a, b)])


L_SHAPE = poly([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)])
RING = poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)])


def test_overlap_of_concave_and_holed():
    assert g.overlap(L_SHAPE, rect(0, 0, 4, 4)) == pytest.approx(7)
    assert g.overlap(L_SHAPE, rect(2, 2, 3, 3)) == pytest.approx(0)
    assert g.overlap(RING, rect(1, 1, 3, 3)) == pytest.approx(0)
    assert g.overlap(RING, rect(0, 0, 2, 2)) == pytest.approx(3)
    assert g.overlap(None, RING) is None


def test_meeting():
    assert g._meet(rect(0, 0, 1, 1), rect(1, 0, 2, 1)) and g._meet(rect(0, 0, 1, 1), rect(1, 1, 2, 2))
    assert not g._meet(rect(0, 0, 1, 1), rect(1.1, 0, 2, 1))
    assert not g._meet(RING, rect(1.5, 1.5, 2, 2)) and g._meet(rect(-1, -1, 5, 5), RING)


box = st.tuples(*[st.floats(-5, 5, allow_nan=False)] * 2, *[st.floats(0.1, 5, allow_nan=False)] * 2)


@settings(max_examples=60, deadline=None)
@given(box, box)
def test_overlap_of_boxes(a, b):
    ra, rb = (rect(x, y, x + w, y + h) for x, y, w, h in (a, b))
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    assert g.overlap(ra, rb) == pytest.approx(w * h, abs=1e-9) and g.overlap(rb, ra) == pytest.approx(w * h, abs=1e-9)


def test_columns(spark):
    df = spark.createDataFrame([(L_SHAPE,), (RING,), (None,)], f"geom {g.GEOMETRY}")
    rows = df.select(g.area(F.col("geom")).alias("a"), g.centroid(F.col("geom")).alias("c"), g.point_on_surface("geom").alias("s"), g.from_wkb(g.to_wkb("geom")).alias("w")).collect()
    assert rows[0].a == pytest.approx(7) and rows[1].a == pytest.approx(12) and rows[2].a is None
    assert (rows[1].c.x, rows[1].c.y) == pytest.approx((2, 2))
    for shape, r in zip((L_SHAPE, RING), rows):
        assert g.overlap(shape, rect(r.s.x - 1e-6, r.s.y - 1e-6, r.s.x + 1e-6, r.s.y + 1e-6)) == pytest.approx(4e-12)
        assert g.overlap(r.w.asDict(recursive=True), shape) == pytest.approx(r.a)
    assert rows[2].w.rings is None


def test_projections(spark):
    lon, lat = F.lit(-66.1), F.lit(18.4)
    x, y = g.to_utm(lon, lat)
    mx, my = g.to_mercator(lon, lat)
    back = g.from_mercator(mx, my)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), back[0].alias("lon"), back[1].alias("lat"), g.haversine_m(lon, lat, lon, lat + 1).alias("d")).first()
    assert (r.lon, r.lat) == pytest.approx((-66.1, 18.4))
    assert r.d == pytest.approx(math.radians(1) * g.EARTH_RADIUS_M)
    # along the central meridian the northing is 0.9996 times the arc; 2.9 degrees east of it the easting grows
    assert 800_000 < r.x < 810_000 and 2_030_000 < r.y < 2_040_000


def test_hexagons_hold_their_points(spark):
    rng = np.random.default_rng(1)
    pts = [(float(a), float(b)) for a, b in rng.uniform(-1e4, 1e4, (500, 2))]
    q, r = g.hex_cell(F.col("x"), F.col("y"), 100.0)
    cx, cy = g.hex_centre(F.col("q"), F.col("r"), 100.0)
    rows = spark.createDataFrame(pts, "x double, y double").withColumns({"q": q, "r": r}).withColumns({"cx": cx, "cy": cy}).collect()
    assert all(math.hypot(p.x - p.cx, p.y - p.cy) <= 100.0 + 1e-6 for p in rows)


def brute(a, b):
    return sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3])


def test_candidate_pairs_of_any_size(spark):
    rng = np.random.default_rng(2)
    shapes = []
    for _ in range(2):
        at, size = rng.uniform(-10, 10, (60, 2)), 10.0 ** rng.uniform(-2, 1, (60, 2))
        shapes.append([(*map(float, p), *map(float, p + s)) for p, s in zip(at, size)])
    a, b = (spark.createDataFrame([(i, *s) for i, s in enumerate(x)] + [(None, None, None, None, None)], "id int, minx double, miny double, maxx double, maxy double") for x in shapes)
    for cell in (0.05, 1.0):
        pairs = spatial.candidate_pairs(a, b, cell=cell).select("l.id", "r.id").collect()
        assert sorted(map(tuple, pairs)) == brute(*shapes)
    assert spatial.candidate_pairs(a.limit(0), b, cell=1.0).count() == 0


def test_morans_permutations(spark):
    areas = [(i, "g", float(i // 4)) for i in range(16)]
    edges = [(i, j, 1.0) for i in range(16) for j in range(16) if i != j and abs(i // 4 - j // 4) <= 1 and abs(i % 4 - j % 4) <= 1]
    df = spark.createDataFrame(areas, "id int, g string, v double")
    e = spark.createDataFrame(edges, "src int, dst int, w double")
    r = statistics.morans_i(df, e, area_id="id", value="v", by="g", permutations=99).first()
    z = np.array([a[2] for a in areas]) - 1.5
    w = np.zeros((16, 16))
    for i, j, _ in edges:
        w[i, j] = 1
    w /= w.sum(1, keepdims=True)
    assert r.moran_i == pytest.approx(float(z @ w @ z / (z @ z))) and r.pseudo_p <= 0.05 and r.z > 2


def test_permutations_by_arrays_as_by_joins(spark, monkeypatch):
    df = spark.range(60).select(F.concat(F.lit("a"), "id").alias("id"), F.when(F.col("id") % 9 == 0, None).otherwise((F.col("id") * 37) % 11).alias("v"), F.concat(F.lit("g"), F.col("id") % 3).alias("g"))
    e = spark.range(57).select(F.explode(F.array(F.struct(F.col("id").alias("a"), (F.col("id") + 3).alias("b")), F.struct((F.col("id") + 3).alias("a"), F.col("id").alias("b")))).alias("e"))
    e = e.where("e.a % 3 <> 2").select(F.concat(F.lit("a"), "e.a").alias("src"), F.concat(F.lit("a"), "e.b").alias("dst"), F.lit(0.5).alias("w"))

    def rows():
        out = statistics.morans_i(df, e, area_id="id", value="v", by="g", permutations=120)
        return sorted((r.g, r.n, round(r.moran_i, 9), r.pseudo_p, round(r.z, 9)) for r in out.collect())

    by_joins, called = statistics._dealt_by_joins, []
    monkeypatch.setattr(statistics, "_dealt_by_joins", lambda *a: called.append(1) or by_joins(*a))
    arrays = rows()
    assert not called and len(arrays) == 2
    monkeypatch.setattr(statistics, "PER_TASK", 0)
    assert rows() == arrays and called
