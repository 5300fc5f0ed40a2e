import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.fixtures import with_box
from geoloom.functions import geometry as g
from geoloom.operators import outlines, overlay
from geoloom.operators.graphs import groups_of
from geoloom.plans import imagery
from geoloom.sources.files import saved

from .test_geometry import L_SHAPE, RING, poly, rect

SCHEMA = f"k string, geom {g.GEOMETRY}"


def turned(shape, degrees, x=0.0, y=0.0):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {"rings": [[{"x": p["x"] * c - p["y"] * s + x, "y": p["x"] * s + p["y"] * c + y} for p in r] for r in shape["rings"]], "srid": 4326}


def union_of_rects(rects):
    xs, ys = (sorted({v for r in rects for v in (r[i], r[i + 2])}) for i in (0, 1))
    total = 0.0
    for (a, b), (c, d) in itertools.product(itertools.pairwise(xs), itertools.pairwise(ys)):
        if any(r[0] <= a and b <= r[2] and r[1] <= c and d <= r[3] for r in rects):
            total += (b - a) * (d - c)
    return total


def box_rows(k, rects):
    return [(k, rect(*r)) for r in rects]


def test_relations(spark):
    star = turned(L_SHAPE, 30, 1, 1)
    again = poly([(4, 0), (4, 1), (2, 1), (1, 1), (1, 4), (0, 4), (0, 2), (0, 0), (4, 0)])  # L_SHAPE from elsewhere, with more vertices
    two = {"rings": [rect(10, 10, 11, 11)["rings"][0], rect(2.5, 2.5, 2.9, 2.9)["rings"][0]], "srid": 4326}
    cases = [
        # a, b, intersects, contains, within, equals
        (L_SHAPE, rect(0, 0, 1, 1), True, True, False, False),
        (L_SHAPE, rect(2, 2, 3, 3), False, False, False, False),
        (L_SHAPE, rect(1, 1, 3, 3), True, False, False, False),  # shares only the inner corner's sides
        (L_SHAPE, rect(0.5, 0.5, 2, 2), True, False, False, False),
        (rect(0, 0, 4, 4), L_SHAPE, True, True, False, False),
        (L_SHAPE, rect(-1, -1, 5, 5), True, False, True, False),
        (L_SHAPE, again, True, True, True, True),
        (RING, rect(1, 1, 3, 3), True, False, False, False),  # the hole itself
        (RING, rect(1.5, 1.5, 2, 2), False, False, False, False),
        (RING, rect(0, 0, 1, 4), True, True, False, False),
        (RING, rect(0, 0, 4, 4), True, False, True, False),
        (RING, two, False, False, False, False),
        (rect(2, 2, 4, 4), two, True, False, False, False),  # only the second part is in it
        (star, turned(rect(0, 0, 1, 1), 30, 1, 1), True, True, False, False),
        (star, turned(again, 30, 1, 1), True, True, True, True),
        (rect(0, 0, 1, 1), rect(1, 0, 2, 1), True, False, False, False),
        (rect(0, 0, 1, 1), rect(0, 0, 1, 1), True, True, True, True),
        (poly(), rect(0, 0, 1, 1), False, False, False, False),
        (None, rect(0, 0, 1, 1), None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], f"i int, a {g.GEOMETRY}, b {g.GEOMETRY}").repartition(2)
    rows = df.select("i", *(f("a", "b").alias(n) for n, f in (("x", g.intersects), ("c", g.contains), ("w", g.within), ("e", g.equals))), g.overlap_area("a", "b").alias("o")).collect()
    assert {r.i: (r.x, r.c, r.w, r.e) for r in rows} == {i: c[2:] for i, c in enumerate(cases)}
    size = {r.i: r.o for r in rows}
    assert size[2] == pytest.approx(0, abs=1e-12) and size[3] == pytest.approx(0.5 * 1.5 * 2 - 0.25) and size[8] == 0 and size[13] == pytest.approx(1) and size[18] is None


def test_overlap_against_sampling(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        shapes = [turned(rng.choice([L_SHAPE, RING]), rng.uniform(0, 360), rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in "ab"]
        rows.append((len(rows), *shapes))
    df = spark.createDataFrame(rows, f"n int, a {g.GEOMETRY}, b {g.GEOMETRY}")
    grid = spark.range(160).selectExpr("id / 10.0D - 8 AS x").crossJoin(spark.range(160).selectExpr("id / 10.0D - 8 AS y"))
    got = {r.n: r.o for r in df.select("n", g.overlap_area("a", "b").alias("o")).collect()}
    points = df.crossJoin(grid)
    hits = points.where(g.contains_point(F.col("a"), F.col("x"), F.col("y")) & g.contains_point(F.col("b"), F.col("x"), F.col("y"))).groupBy("n").count().collect()
    want = {r.n: r["count"] / 100 for r in hits}
    for n, area in got.items():
        assert area == pytest.approx(want.get(n, 0), abs=0.35)


def test_union_of_boxes_against_brute_force(spark):
    rng = random.Random(2)
    groups, rows = {}, []
    for k in range(8):
        rects = [(x := rng.randrange(12), y := rng.randrange(12), x + rng.randrange(1, 6), y + rng.randrange(1, 6)) for _ in range(rng.randrange(1, 14))]
        groups[str(k)] = rects
        rows += box_rows(str(k), rects) + box_rows(str(k), rects[:2])
    rows += [("none", None), ("empty", poly())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    edges = overlay.boundary(df, ["k"], cell=2.0)
    area = {r.k: r.area for r in overlay.boundary_area(edges, ["k"]).collect()}
    shape = {r.k: r for r in overlay.chained(edges, ["k"]).select("k", g.area(F.col("geom")).alias("a"), g.perimeter(F.col("geom")).alias("p")).collect()}
    assert set(area) == set(shape) == set(groups)
    for k, rects in groups.items():
        assert area[k] == pytest.approx(union_of_rects(rects)) and shape[k].a == pytest.approx(area[k])
    import numpy as np

    for rects in groups.values():
        assert outlines.union_of_boxes(np.array(rects, float)) == pytest.approx(union_of_rects(rects))


def test_union_of_a_tiling_has_no_inner_edges(spark):
    # cells of unequal width above each other, so that borders don't match vertex by vertex
    rects = [(i, 0, i + 1, 1) for i in range(6)] + [(2 * i, 1, 2 * i + 2, 2) for i in range(3)] + [(0, 2, 6, 3)]
    rects.remove((3, 0, 4, 1))
    hole = [(10 + i, j, 11 + i, j + 1) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    df = spark.createDataFrame(box_rows("a", rects) + box_rows("b", hole) + box_rows("c", [(0, 0, 1, 1), (1, 1, 2, 2)]), SCHEMA)
    got = {r.k: r.geom for r in overlay.overlay(df, ["k"], cell=1.0).collect()}
    ring = lambda r: {(p.x, p.y) for p in r}
    (a,) = got["a"].rings
    assert ring(a) == {(0, 0), (3, 0), (3, 1), (4, 1), (4, 0), (6, 0), (6, 3), (0, 3)} and len(a) == 9
    assert [ring(r) for r in got["b"].rings] == [{(10, 0), (13, 0), (13, 3), (10, 3)}, {(11, 1), (12, 1), (12, 2), (11, 2)}]
    assert sorted(len(r) for r in got["c"].rings) == [5, 5]  # squares that touch at a corner stay two rings
    parts = overlay.overlay(df, ["k"], cell=1.0, parts=True).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in parts} == {"a": 1, "b": 1, "c": 2}


def test_results_of_two_polygons(spark):
    rng = random.Random(9)
    rows_a, rows_b, want = [], [], {}
    for k in range(12):
        a, b = (turned(rng.choice([L_SHAPE, RING]), rng.uniform(0, 360), rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in "ab")
        rows_a.append((str(k), a)), rows_b.append((str(k), b))
        size = {"a": 7 if a["rings"][0].__len__() == 7 else 12, "b": 7 if len(b["rings"][0]) == 7 else 12, "both": g.overlap(a, b)}
        want[str(k)] = size
    a, b = spark.createDataFrame(rows_a, SCHEMA), spark.createDataFrame(rows_b, SCHEMA)
    for result, area in (("union", lambda s: s["a"] + s["b"] - s["both"]), ("intersection", lambda s: s["both"]), ("difference", lambda s: s["a"] - s["both"])):
        edges = overlay.boundary(a, ["k"], cell=1.0, other=b, result=result)
        got = {r.k: r.area for r in overlay.boundary_area(edges, ["k"]).collect()}
        shapes = {r.k: r.a for r in overlay.chained(edges, ["k"]).select("k", g.area(F.col("geom")).alias("a")).collect()}
        for k, s in want.items():
            assert got.get(k, 0) == pytest.approx(area(s), abs=1e-6) and shapes.get(k, 0) == pytest.approx(area(s), abs=1e-6)


def test_growing_and_shrinking(spark):
    tall = turned(rect(0, 0, 2, 6), 20, 5, 5)
    rows = [("box", rect(0, 0, 4, 3)), ("L", L_SHAPE), ("ring", RING), ("turned", tall), ("thin", rect(0, 0, 9, 0.5))]
    df = spark.createDataFrame(rows, SCHEMA)
    size = lambda d: {r.k: r.a for r in outlines.grown(df, ["k"], d, cell=1.0).select("k", g.area(F.col("geom")).alias("a")).collect()}
    out = size(0.5)
    assert out == pytest.approx({"box": 5 * 4, "L": 5 * 5 - 3 * 3, "ring": 25 - 1, "turned": 3 * 7, "thin": 10 * 1.5}, abs=1e-4)
    less = size(-0.25)
    assert less == pytest.approx({"box": 3.5 * 2.5, "L": 3.5 * 0.5 + 3 * 0.5, "ring": 3.5**2 - 2.5**2, "turned": 1.5 * 5.5}, abs=1e-4)
    assert size(0) == pytest.approx({"box": 12, "L": 7, "ring": 12, "turned": 12, "thin": 4.5}, abs=1e-4)


def test_sharp_corners_are_cut(spark):
    spike = poly([(0, 0), (20, 0), (0, 1), (0, 0)])
    df = spark.createDataFrame([("a", spike)], SCHEMA)
    (r,) = outlines.grown(df, ["k"], 1.0, cell=1.0).collect()
    assert max(p.x for p in r.geom.rings[0]) < 21.2


def test_arrays_of_panels(spark):
    row = [rect(2.0 * i, 0, 2.0 * i + 1.2, 3) for i in (0, 1, 2, 5, 6)]  # gaps of 0.8 close, one of 4.8 stays
    panels = [(i, s) for i, s in enumerate(row)] + [(9, turned(rect(0, 0, 4, 4), 45, 50, 50)), (10, rect(100, 100, 100.5, 100.5)), (11, None), (2, row[2])]
    df = spark.createDataFrame(panels, f"panel_id int, geom {g.GEOMETRY}")
    arrays, member = outlines.panel_arrays(df, panel_id="panel_id", cell=2.0)
    rows = {r.array_group: r for r in arrays.collect()}
    assert {k: round(r.area, 3) for k, r in rows.items()} == {0: round((5.2 + 1.3) * 4.3, 3), 3: round((3.2 + 1.3) * 4.3, 3), 9: round(5.3**2, 3)}
    assert {(r.panel_id, r.array_group) for r in member.collect()} == {(0, 0), (1, 0), (2, 0), (5 - 2, 3), (4, 3), (9, 9), (10, 10)}


def test_clipping(spark):
    shapes = [L_SHAPE, RING, turned(RING, 33, 0.5, -0.5), turned(L_SHAPE, 200, 2, 2)]
    windows = [(0, 0, 2, 2), (1, 1, 3, 3), (-1, 0.5, 2.5, 1.5), (-9, -9, 9, 9), (8, 8, 9, 9)]
    rows = [(s, rect(*w), *map(float, w)) for s in shapes for w in windows] + [(None, rect(0, 0, 1, 1), 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, f"s {g.GEOMETRY}, b {g.GEOMETRY}, x0 double, y0 double, x1 double, y1 double")
    cut = outlines.clipped(F.col("s"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    cuts = saved(df.withColumn("cut", cut), "cuts")
    got = cuts.select(g.area(F.col("cut")).alias("a"), g.overlap_area("s", "b").alias("o"), g.overlap_area("cut", "b").alias("again")).collect()
    assert sorted(r.a is None for r in got) == [False] * 20 + [True]
    for r in (r for r in got if r.a is not None):
        assert r.a == pytest.approx(r.o, abs=1e-9) and r.again == pytest.approx(r.o, abs=1e-9)


def test_covered_area_in_strips(spark):
    rng = random.Random(4)
    rects = [(x := rng.uniform(-1, 9), y := rng.uniform(-1, 9), x + rng.uniform(0.1, 4), y + rng.uniform(0.1, 4)) for _ in range(60)]
    names = "minx double, miny double, maxx double, maxy double"
    foot = spark.createDataFrame([(i, f"s{i % 3}", *r, rect(*r)) for i, r in enumerate(rects)], f"item int, source string, {names}, geom {g.GEOMETRY}")
    areas = spark.createDataFrame([(k, *map(float, r), rect(*r)) for k, r in (("a", (0, 0, 10, 10)), ("b", (2, 2, 3, 3)), ("far", (50, 50, 51, 51)))], f"area string, {names}, geom {g.GEOMETRY}")
    want = {}
    for k, (a, b, c, d) in (("a", (0, 0, 10, 10)), ("b", (2, 2, 3, 3))):
        cut = [(max(a, r[0]), max(b, r[1]), min(c, r[2]), min(d, r[3])) for r in rects]
        want[k] = union_of_rects([r for r in cut if r[0] < r[2] and r[1] < r[3]])
    for options in ({"boxes": True}, {"boxes": True, "per_strip": 7}, {"boxes": False}):
        got = {r.area: r.covered for r in outlines.covered_area(areas, foot, area_id="area", cell=1.0, **options).collect()}
        assert {k: v for k, v in got.items() if v} == pytest.approx(want, abs=1e-6)
    rows = {r.area: r for r in imagery.area_coverage(areas, foot, area_id="area", item_id="item", source="source", cell=1.0, boxes=True).collect()}
    assert rows["far"].asDict() == {"area": "far", "items": 0, "sources": "", "covered": 0.0} and rows["a"].sources == "s0, s1, s2" and rows["a"].covered == pytest.approx(want["a"])


def test_touched_cells_against_brute_force(spark):
    rng = random.Random(3)
    shapes = [turned(rng.choice([L_SHAPE, RING]), rng.uniform(1, 89), rng.uniform(-2, 6), rng.uniform(-2, 6)) for _ in range(12)] + [rect(1.2, 1.2, 1.3, 1.4), rect(0.6, 0.55, 6.45, 1.4)]
    chips = spark.createDataFrame([("c", 0.0, 0.0, 8.0, 8.0)], "chip string, minx double, miny double, maxx double, maxy double")
    n = 16
    for shape in shapes:
        polygons = outlines.boxed(spark.createDataFrame([("p", shape)], SCHEMA))
        got = {(r.row, r.col) for r in imagery.touched_grid(chips, polygons, chip_id="chip", cells=n, cell=1.0).collect()}
        want = {(n - 1 - j, i) for i in range(n) for j in range(n) if g._meet(shape, rect(i / 2, j / 2, i / 2 + 0.5, j / 2 + 0.5))}
        assert got == want


def test_cells_of_hexagons(spark):
    df = spark.createDataFrame(list(enumerate((turned(L_SHAPE, 25, 3, 1), RING, rect(-3.3, -2.2, 4.1, 5.7)))), f"n int, geom {g.GEOMETRY}")
    edge = 0.3
    cover = df.select("n", "geom", F.explode(g.hex_cover(F.col("geom"), edge)).alias("c")).select("n", "geom", "c.q", "c.r")
    grid = spark.range(-60, 60).withColumnRenamed("id", "q").crossJoin(spark.range(-60, 60).withColumnRenamed("id", "r"))
    x, y = g.hex_centre(F.col("q"), F.col("r"), edge)
    want = df.crossJoin(grid).where(g.contains_point(F.col("geom"), x, y))
    assert cover.select("n", "q", "r").count() > 300
    assert cover.select("n", "q", "r").exceptAll(want.select("n", "q", "r")).isEmpty() and want.select("n", "q", "r").exceptAll(cover.select("n", "q", "r")).isEmpty()
    ring = cover.limit(50).withColumn("cell", g.hex_boundary(F.col("q"), F.col("r"), edge))
    q, r = g.hex_cell(*g.hex_centre(F.col("q"), F.col("r"), edge), edge)
    for row in ring.select(g.area(F.col("cell")).alias("a"), (q == F.col("q")).alias("same_q"), (r == F.col("r")).alias("same_r"), g.perimeter(F.col("cell")).alias("p")).collect():
        assert row.a == pytest.approx(1.5 * 3**0.5 * edge**2) and row.p == pytest.approx(6 * edge) and row.same_q and row.same_r


def test_groups(spark):
    from geoloom.operators.graphs import groups_of

    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 3), (41, 200)]
    got = {r.node: r.group for r in groups_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 41: 41, 200: 41}
    assert groups_of(spark.createDataFrame([], "a long, b long")).isEmpty()


def counted(monkeypatch):
    """Rows that operators write, in a list."""
    rows = []

    def keep(df, name):
        out = saved(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(overlay, "saved", keep)
    monkeypatch.setattr(outlines, "saved", keep)
    return rows


def test_footprints_upon_each_other_are_not_cut_by_each_other(spark, monkeypatch):
    rng = random.Random(5)
    rects = [(x, y, x + rng.uniform(2, 5), y + rng.uniform(2, 5)) for x, y in ((rng.uniform(-4, 9), rng.uniform(-4, 9)) for _ in range(600))]
    foot = outlines.boxed(spark.createDataFrame([(rect(*r),) for r in rects], f"geom {g.GEOMETRY}"))
    areas = outlines.boxed(spark.createDataFrame([("a", rect(0, 0, 12, 12)), ("b", L_SHAPE)], f"id string, geom {g.GEOMETRY}"))
    written = counted(monkeypatch)
    found = {r.id: r.covered for r in outlines.covered_area(areas, foot, area_id="id", cell=1.0).collect()}
    inside = [(max(r[0], 0), max(r[1], 0), min(r[2], 12), min(r[3], 12)) for r in rects]
    assert found["a"] == pytest.approx(union_of_rects([r for r in inside if r[0] < r[2] and r[1] < r[3]]), abs=1e-6)
    assert 0 < found["b"] <= 12
    assert sum(written) < 20 * len(rects)


def test_tiles_of_concave_footprints(spark):
    shapes = [turned(L_SHAPE, 17 * k, 3 + k % 5, 3 + k % 3) for k in range(40)] + [RING, L_SHAPE]
    foot = outlines.boxed(spark.createDataFrame([(s,) for s in shapes], f"geom {g.GEOMETRY}"))
    areas = outlines.boxed(spark.createDataFrame([("a", rect(0, 0, 9, 9))], f"id string, geom {g.GEOMETRY}"))
    found = outlines.covered_area(areas, foot, area_id="id", cell=1.0).first().covered
    whole = overlay.boundary(foot.select(F.lit("a").alias("k"), "geom"), ["k"], cell=1.0, other=areas.select(F.col("id").alias("k"), "geom"), result="intersection")
    assert found == pytest.approx(overlay.boundary_area(whole, ["k"]).first().area, abs=1e-6)


@pytest.mark.parametrize("result", list(overlay.RESULTS))
def test_small_groups_as_large_ones(spark, monkeypatch, result):
    rng = random.Random(11)
    some = lambda n: [(rng.choice("abc") if rng.random() < 0.9 else None, turned(rng.choice([L_SHAPE, RING, rect(0, 0, 2, 1)]), rng.choice([0, 0, 90, 33]), rng.randint(0, 4), rng.randint(0, 4))) for _ in range(n)]
    first, second = (spark.createDataFrame(some(n), SCHEMA) for n in (14, 9))

    def areas():
        edges = overlay.boundary(first, ["k"], cell=1.0, other=second, result=result)
        return {r.k: r.area for r in overlay.boundary_area(edges, ["k"]).collect()}, edges.count()

    written = counted(monkeypatch)
    small, n = areas()
    assert sum(written) <= 23  # the shapes, once
    monkeypatch.setattr(overlay, "PER_TASK", 0)
    large, m = areas()
    assert small == pytest.approx(large, abs=1e-6) and n == m


def test_linked_boxes_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    at, size = rng.uniform(-60, 60, (700, 2)), rng.uniform(0, 5, (700, 2))
    boxes = [(f"b{i}", float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(at, size))]
    boxes += [("wide", -61.0, 30.0, 61.0, 30.5), ("edge", 100.0, 0.0, 112.0, 1.0), ("edge2", 112.0, 1.0, 113.0, 2.0), ("alone", 500.0, 500.0, 501.0, 501.0)]
    boxes += [(f"row{i}", 2000.0 + 2 * i, 0.0, 2002.0 + 2 * i, 1.0) for i in range(60)] + [("none", None, None, None, None)]
    name = {b[0]: b[0] for b in boxes}
    changed = True
    while changed:
        changed = False
        for a in boxes[:-1]:
            for b in boxes[:-1]:
                if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4] and name[a[0]] != name[b[0]]:
                    name[a[0]] = name[b[0]] = min(name[a[0]], name[b[0]])
                    changed = True
    df = saved(spark.createDataFrame(boxes, "id string, minx double, miny double, maxx double, maxy double").repartition(3), "boxes")
    for per_tile, side in ((4096, 16.0), (10, 16.0), (4096, 512.0)):
        monkeypatch.setattr(outlines, "PER_TILE", per_tile)
        assert {r.id: r.group for r in outlines.linked_boxes(df, side).collect()} == name


def test_arrays_shuffle_few_rows(spark, monkeypatch):
    """Links within a tile aren't rows; what is paired or named in rounds are only panels on tiles' borders."""
    panels = spark.range(4000).selectExpr("id AS panel_id", "2D * (id % 40) AS minx", "6D * floor(id / 40) AS miny", "2D * (id % 40) + 1.2 AS maxx", "6D * floor(id / 40) + 1 AS maxy")
    seen = []
    monkeypatch.setattr(outlines, "groups_of", lambda links: seen.append(links.count()) or groups_of(links))
    arrays, member = outlines.panel_arrays(with_box(panels), panel_id="panel_id", cell=2.0)
    assert arrays.count() == 100 and member.groupBy("array_group").count().where("count = 40").count() == 100
    assert sum(seen) < 1000


@pytest.mark.parametrize("per_task", [512, 30])
def test_areas_of_several_results(spark, monkeypatch, per_task):
    rng = random.Random(3)
    rects = lambda n: [(x := rng.randint(0, 9), y := rng.randint(0, 9), x + rng.randint(1, 5), y + rng.randint(1, 5)) for _ in range(n)]
    first = {k: rects(n) for k, n in (("a", 3), ("b", 9), ("c", 1), ("d", 2))} | {"c": [(0, 0, 1, 1)]}
    second = {k: rects(n) for k, n in (("a", 1), ("b", 4))} | {"c": [(5, 5, 6, 6)], "e": [(0, 0, 2, 2)]}
    frame = lambda of: spark.createDataFrame([r for k, rs in of.items() for r in box_rows(k, rs)], SCHEMA)
    monkeypatch.setattr(overlay, "PER_TASK", per_task)
    names = {"one": "first", "both": "intersection", "rest": "rest", "all": "union"}
    out = overlay.areas(frame(first), ["k"], cell=2.0, other=frame(second), results=names)
    shuffles = out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert per_task == 30 or shuffles == 1  # shapes only
    want = {}
    for k in "abcde":
        a, b = first.get(k, []), second.get(k, [])
        one, two, both = (union_of_rects(r) for r in (a, b, a + b))
        want[k] = (one, one + two - both, both - one, both)
    got = {r.k: (r.one, r.both, r["rest"], r.all) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_shapes_of_one_size_are_listed_once(spark):
    from geoloom.operators.spatial import _levelled, _listed

    df = spark.range(50).selectExpr("id", "10D * id AS minx", "10D * id + 0.5 AS maxx", "0.1D AS miny", "0.5D AS maxy")
    listed = {s: _listed(_levelled(df, 1.0, 24), s, s, 1.0, [0], []).count() for s in "lr"}
    assert listed == {"l": 50, "r": 50}
