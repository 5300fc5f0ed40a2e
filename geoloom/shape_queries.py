"""Queries over outlines of shapes, each with SQL for the same rows. Shapes are boxes, or made of boxes, so that SQL can say what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import expanded, fixture, with_box
from .functions import geometry as g
from .functions import wkt
from .operators import outlines, overlay
from .plans import imagery
from .queries import SMALL
from .sources.files import saved, spread


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _polygon(*points) -> F.Column:
    """One ring through points given as pairs of SQL expressions."""
    ring = [g.point_struct(F.expr(x), F.expr(y)) for x, y in [*points, points[0]]]
    return F.array(*ring)


def _shape(*rings) -> F.Column:
    return F.struct(F.array(*rings).alias("rings"), F.lit(4326).alias("srid"))


def county_boundaries(spark, d) -> DataFrame:
    """Counties as the union of their block groups: area, length of the boundary, bounds, and how many rings and corners are left."""
    bg = with_box(fixture(spark, d, "block_groups"))
    out = overlay.overlay(bg, ["county_geoid"], cell=0.03)
    box = g.envelope(F.col("geom"))
    corners = F.aggregate(F.transform("geom.rings", lambda r: F.size(r) - 1), F.lit(0), lambda a, n: a + n)
    return out.select("county_geoid", _r(g.area(F.col("geom"))).alias("area"), _r(g.perimeter(F.col("geom"))).alias("length"), *(_r(c).alias(n) for n, c in box.items()), F.size("geom.rings").alias("rings"), corners.alias("corners"))


COUNTY_SQL = """
SELECT county_geoid, round(sum((maxx - minx) * (maxy - miny)), 6) area, round(2 * (max(maxx) - min(minx) + max(maxy) - min(miny)), 6) AS length, round(min(minx), 6) minx, round(min(miny), 6) miny,
  round(max(maxx), 6) maxx, round(max(maxy), 6) maxy, 1 rings, 4 corners
FROM {block_groups} GROUP BY 1"""


def island_area(spark, d) -> DataFrame:
    """All block groups united, by the sum over the boundary's edges; counties don't match vertex by vertex."""
    bg = with_box(fixture(spark, d, "block_groups"))
    edges = overlay.boundary(bg, cell=0.03)
    return overlay.boundary_area(edges).select(_r("area").alias("area"))


ISLAND_SQL = "SELECT round(sum((maxx - minx) * (maxy - miny)), 6) area FROM {block_groups}"


def roof_outlines(spark, d) -> DataFrame:
    """Per building with panels: area of its panels united, of what of them lies on the building, and of the free roof. Panels overlap."""
    side = ("minx", "miny", "maxx", "maxy")
    b, p = fixture(spark, d, "buildings").select("building_id", *side), fixture(spark, d, "panels").select(*side)
    pairs = outlines.candidate_pairs(p, b, cell=SMALL).where("r.building_id IS NOT NULL")
    pairs = saved(pairs.select("r.building_id", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in side)), "pairs")
    boxes = lambda df, s: df.select("building_id", g.box(*(F.col(f"{s}_{c}") for c in side)).alias("geom"))
    roofs = pairs.select("building_id", *(f"r_{c}" for c in side)).distinct()
    out = overlay.areas(boxes(pairs, "l"), ["building_id"], cell=SMALL, other=boxes(roofs, "r"), results={"united": "first", "on_roof": "intersection", "free": "rest"})
    return out.select("building_id", *(_r(F.col(c) * 1e9, 2).alias(c) for c in ("united", "on_roof", "free")))


ROOF_SQL = """
WITH a AS (SELECT * FROM {buildings}), b AS (SELECT * FROM {panels}),
p AS (SELECT a.building_id, b.minx, b.maxx, b.miny, b.maxy, a.minx x0, a.maxx x1, a.miny y0, a.maxy y1 FROM a JOIN b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy),
e AS (SELECT building_id, x FROM p, (SELECT 1 k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k, LATERAL (SELECT CASE k.k WHEN 1 THEN minx WHEN 2 THEN maxx WHEN 3 THEN x0 ELSE x1 END x) GROUP BY ALL),
f AS (SELECT building_id, y FROM p, (SELECT 1 k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k, LATERAL (SELECT CASE k.k WHEN 1 THEN miny WHEN 2 THEN maxy WHEN 3 THEN y0 ELSE y1 END y) GROUP BY ALL),
i AS (SELECT building_id, x u, lead(x) OVER (PARTITION BY building_id ORDER BY x) v FROM e),
j AS (SELECT building_id, y s, lead(y) OVER (PARTITION BY building_id ORDER BY y) t FROM f),
c AS (SELECT i.building_id, (v - u) * (t - s) size, bool_or(minx <= u AND v <= maxx AND miny <= s AND t <= maxy) panel, bool_or(x0 <= u AND v <= x1 AND y0 <= s AND t <= y1) roof
  FROM i JOIN j ON i.building_id = j.building_id JOIN p ON p.building_id = i.building_id WHERE v IS NOT NULL AND t IS NOT NULL GROUP BY i.building_id, u, v, s, t)
SELECT building_id, round(coalesce(sum(size) FILTER (panel), 0) * 1e9, 2) united, round(coalesce(sum(size) FILTER (panel AND roof), 0) * 1e9, 2) on_roof, round(coalesce(sum(size) FILTER (roof AND NOT panel), 0) * 1e9, 2) free
FROM c GROUP BY 1"""


def polygon_relations(spark, d) -> DataFrame:
    """Panels against buildings that are L-shaped, or have a court: how many meet, lie inside, and what they overlap."""
    b = fixture(spark, d, "buildings").withColumns({"mx": F.col("lon"), "my": F.col("lat"), "w": F.col("maxx") - F.col("lon")})
    ell = _polygon(("minx", "miny"), ("maxx", "miny"), ("maxx", "my"), ("mx", "my"), ("mx", "maxy"), ("minx", "maxy"))
    outer = _polygon(("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))
    court = _polygon(("mx - w / 2", "my - w / 2"), ("mx - w / 2", "my + w / 2"), ("mx + w / 2", "my + w / 2"), ("mx + w / 2", "my - w / 2"))
    shapes = b.select("building_id", "minx", "miny", "maxx", "maxy", F.when(F.col("building_id") % 2 == 0, _shape(ell)).otherwise(_shape(outer, court)).alias("geom"))
    p = with_box(fixture(spark, d, "panels")).select("panel_id", "minx", "miny", "maxx", "maxy", "geom")
    pairs = outlines.candidate_pairs(shapes, p, cell=SMALL)
    rows = pairs.select(
        F.when(F.col("l.building_id") % 2 == 0, "ell").otherwise("court").alias("shape"), g.intersects("l.geom", "r.geom").cast("int").alias("meets"), g.contains("l.geom", "r.geom").cast("int").alias("contains"),
        g.within("r.geom", "l.geom").cast("int").alias("within"), g.equals("l.geom", "r.geom").cast("int").alias("equals"), g.overlap_area("l.geom", "r.geom").alias("overlap"),
    )
    return rows.groupBy("shape").agg(F.count("*").alias("pairs"), *(F.sum(c).alias(c) for c in ("meets", "contains", "within", "equals")), _r(F.sum("overlap") * 1e6, 4).alias("overlap"))


def _part(x0: str, y0: str, x1: str, y1: str) -> str:
    """SQL for the overlap of panel b and a box."""
    return f"greatest(0, least(b.maxx, {x1}) - greatest(b.minx, {x0})) * greatest(0, least(b.maxy, {y1}) - greatest(b.miny, {y0}))"


def _meets(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(b.minx <= {x1} AND {x0} <= b.maxx AND b.miny <= {y1} AND {y0} <= b.maxy)"


_WHOLE = ("a.minx", "a.miny", "a.maxx", "a.maxy")
_COURT = ("a.lon - w / 2", "a.lat - w / 2", "a.lon + w / 2", "a.lat + w / 2")
_SIDES = [("a.minx", "a.miny", "a.maxx", "a.lat - w / 2"), ("a.minx", "a.lat + w / 2", "a.maxx", "a.maxy"), ("a.minx", "a.miny", "a.lon - w / 2", "a.maxy"), ("a.lon + w / 2", "a.miny", "a.maxx", "a.maxy")]
RELATION_SQL = f"""
WITH a AS (SELECT *, maxx - lon w FROM {{buildings}}), b AS (SELECT * FROM {{panels}}),
r AS (SELECT CASE WHEN building_id % 2 = 0 THEN 'ell' ELSE 'court' END shape, (b.maxx - b.minx) * (b.maxy - b.miny) size,
  CASE WHEN building_id % 2 = 0 THEN {_meets("a.minx", "a.miny", "a.maxx", "a.lat")} OR {_meets("a.minx", "a.miny", "a.lon", "a.maxy")} ELSE {" OR ".join(_meets(*s) for s in _SIDES)} END meets,
  {_part(*_WHOLE)} - CASE WHEN building_id % 2 = 0 THEN {_part("a.lon", "a.lat", "a.maxx", "a.maxy")} ELSE {_part(*_COURT)} END o
  FROM a JOIN b ON {_meets(*_WHOLE)})
SELECT shape, count(*) pairs, count(*) FILTER (meets) AS meets, count(*) FILTER (o >= size * (1 - 1e-9)) AS contains, count(*) FILTER (o >= size * (1 - 1e-9)) AS within, 0::BIGINT AS equals, round(sum(o) * 1e6, 4) AS overlap
FROM r GROUP BY 1"""


def _footprints(spark, d) -> DataFrame:
    return with_box(spark.sql(_FOOT_SQL, supplier=fixture(spark, d, "supplier")))


_FOOT_SQL = """
SELECT s_suppkey AS item, concat('s', CAST(s_suppkey % 3 AS STRING)) AS source, x AS minx, y AS miny, x + (1 + s_suppkey % 5) * 3e-2 AS maxx, y + (1 + s_suppkey % 4) * 2e-2 AS maxy
FROM (SELECT s_suppkey, 1.5e0 * ((s_suppkey * 7919) % 103) / 103 - 6.76e1 AS x, 6e-1 * ((s_suppkey * 104729) % 101) / 101 + 1.785e1 AS y FROM {supplier})"""


def covered_share(spark, d) -> DataFrame:
    """Counties by the footprints that meet them, their sources, and the area covered: by a sweep over boxes, and by the edges of polygons."""
    c, foot = with_box(fixture(spark, d, "counties")), _footprints(spark, d)
    out = imagery.area_coverage(c, foot, area_id="geoid", item_id="item", source="source", cell=0.05, boxes=True)
    edges = outlines.covered_area(c, foot, area_id="geoid", cell=0.05).withColumnRenamed("covered", "by_edges")
    out = out.join(edges, "geoid", "left")
    return out.select("geoid", "items", "sources", _r("covered").alias("covered"), _r(F.coalesce("by_edges", F.lit(0.0))).alias("by_edges"))


COVER_SQL = """
WITH f AS (""" + _FOOT_SQL + """), a AS (SELECT * FROM {counties}),
p AS (SELECT geoid, item, source, greatest(a.minx, f.minx) x0, least(a.maxx, f.maxx) x1, greatest(a.miny, f.miny) y0, least(a.maxy, f.maxy) y1 FROM a JOIN f ON a.minx <= f.maxx AND f.minx <= a.maxx AND a.miny <= f.maxy AND f.miny <= a.maxy),
x AS (SELECT geoid, x, lead(x) OVER (PARTITION BY geoid ORDER BY x) v FROM (SELECT geoid, x0 x FROM p UNION SELECT geoid, x1 FROM p)),
y AS (SELECT geoid, y, lead(y) OVER (PARTITION BY geoid ORDER BY y) t FROM (SELECT geoid, y0 y FROM p UNION SELECT geoid, y1 FROM p)),
c AS (SELECT DISTINCT x.geoid, x, v, y, t FROM x JOIN y ON x.geoid = y.geoid JOIN p ON p.geoid = x.geoid AND x0 <= x AND v <= x1 AND y0 <= y AND t <= y1),
s AS (SELECT geoid, sum((v - x) * (t - y)) s FROM c GROUP BY 1),
n AS (SELECT geoid, count(*) n, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ', ') q FROM p GROUP BY 1)
SELECT a.geoid, coalesce(n, 0) items, coalesce(q, '') sources, round(coalesce(s, 0), 6) covered, round(coalesce(s, 0), 6) by_edges FROM a LEFT JOIN s ON a.geoid = s.geoid LEFT JOIN n ON a.geoid = n.geoid"""

_ROWS_SQL = """
SELECT p_partkey AS panel_id, p_partkey % 40 AS i, CAST(FLOOR(p_partkey / 40) AS BIGINT) AS j, 2e0 * (p_partkey % 40) AS minx, 6e0 * FLOOR(p_partkey / 40) AS miny, 2e0 * (p_partkey % 40) + 1.2e0 AS maxx, 6e0 * FLOOR(p_partkey / 40) + 1e0 AS maxy
FROM {part} WHERE p_size % 7 <> 0"""


def array_outlines(spark, d) -> DataFrame:
    """Arrays from rows of panels: gaps of 0.8 close, a missing panel leaves two arrays, single panels are too small."""
    panels = with_box(spark.sql(_ROWS_SQL, part=fixture(spark, d, "part")))
    arrays, member = outlines.panel_arrays(panels, panel_id="panel_id", cell=2.0)
    n = member.groupBy("array_group").agg(F.count("*").alias("panels"))
    box = g.envelope(F.col("geom"))
    return arrays.join(n, "array_group").select("array_group", "panels", _r("area", 4).alias("area"), "rank", _r(box["minx"], 4).alias("minx"), _r(box["maxx"], 4).alias("maxx"))


ARRAY_SQL = """
WITH p AS (""" + _ROWS_SQL + """),
g AS (SELECT *, i - row_number() OVER (PARTITION BY j ORDER BY i) k FROM p),
a AS (SELECT min(panel_id) array_group, count(*) panels, min(minx) - 0.65 minx, max(maxx) + 0.65 maxx FROM g GROUP BY j, k)
SELECT array_group, panels, round((maxx - minx) * 2.3, 4) area, 1 AS rank, round(minx, 4) minx, round(maxx, 4) maxx FROM a WHERE (maxx - minx) * 2.3 >= 8"""


def clip_metrics(spark, d) -> DataFrame:
    """Windows around buildings: panels, arrays and buildings clipped to them, and their ratios."""
    b, p = with_box(fixture(spark, d, "buildings")), with_box(fixture(spark, d, "panels"))
    chips = b.select("building_id", *(c.alias(n) for n, c in imagery.chip_bounds(F.col("lon") + 3e-5, F.col("lat"), F.lit(1.2e-4)).items()))
    out = outlines.clip_metrics(chips, p, p.where("size % 2 = 0"), b, window_id="building_id", cell=SMALL)
    area = [_r(F.col(f"{k}_area") * 1e9, 3).alias(f"{k}_area") for k in ("panel", "array", "building")]
    return out.select("building_id", "panel_count", "array_count", "building_count", *area, _r("array_to_panel_ratio").alias("array_to_panel_ratio"), _r("panel_coverage_pct", 4).alias("panel_coverage_pct"))


def _clip_sql(table: str, name: str, where: str = "") -> str:
    return f"""
{name} AS (SELECT k.building_id, count(*) n, sum(o) s FROM (SELECT k.building_id, greatest(0, least(k.x1, b.maxx) - greatest(k.x0, b.minx)) * greatest(0, least(k.y1, b.maxy) - greatest(k.y0, b.miny)) o
  FROM k JOIN {table} b ON k.x0 <= b.maxx AND b.minx <= k.x1 AND k.y0 <= b.maxy AND b.miny <= k.y1 {where}) k WHERE o > 0 GROUP BY 1)"""


CLIP_SQL = f"""
WITH a AS (SELECT * FROM {{buildings}}), q AS (SELECT * FROM {{panels}}), k AS (SELECT building_id, lon + 3e-5 - 6e-5 x0, lon + 3e-5 + 6e-5 x1, lat - 6e-5 y0, lat + 6e-5 y1 FROM a),
{_clip_sql("q", "p")}, {_clip_sql("q", "r", "AND size % 2 = 0")}, {_clip_sql("a", "h")}
SELECT k.building_id, coalesce(p.n, 0) panel_count, coalesce(r.n, 0) array_count, coalesce(h.n, 0) building_count, round(coalesce(p.s, 0) * 1e9, 3) panel_area, round(coalesce(r.s, 0) * 1e9, 3) array_area,
  round(coalesce(h.s, 0) * 1e9, 3) building_area, round(coalesce(r.s, 0) / p.s, 6) array_to_panel_ratio, round(coalesce(p.s, 0) / h.s * 100, 4) panel_coverage_pct
FROM k LEFT JOIN p ON k.building_id = p.building_id LEFT JOIN r ON k.building_id = r.building_id LEFT JOIN h ON k.building_id = h.building_id"""


def touched_cells(spark, d) -> DataFrame:
    """Cells of a grid over each county that footprints touch, and those whose centre they hold."""
    c, foot = fixture(spark, d, "counties"), _footprints(spark, d)
    held = saved(imagery.label_grid(c, foot, chip_id="geoid", cells=64, cell=0.05), "held")
    touched = imagery.touched_grid(c, foot, chip_id="geoid", cells=64, cell=0.05, held=held).groupBy("geoid").agg(F.count("*").alias("touched"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))
    centred = held.groupBy("geoid").agg(F.count("*").alias("centred"))
    return c.select("geoid").join(touched, "geoid", "left").join(centred, "geoid", "left").na.fill(0)


TOUCH_SQL = """
WITH f AS (""" + _FOOT_SQL + """), a AS (SELECT * FROM {counties}),
p AS (SELECT geoid, (f.minx - a.minx) / ((a.maxx - a.minx) / 64) x0, (f.maxx - a.minx) / ((a.maxx - a.minx) / 64) x1, (f.miny - a.miny) / ((a.maxy - a.miny) / 64) y0, (f.maxy - a.miny) / ((a.maxy - a.miny) / 64) y1
  FROM a JOIN f ON a.minx <= f.maxx AND f.minx <= a.maxx AND a.miny <= f.maxy AND f.miny <= a.maxy),
k AS (SELECT range i FROM range(64)),
t AS (SELECT geoid, i.i, j.i j, bool_or(x0 <= i.i + 0.5 AND i.i + 0.5 < x1 AND y0 <= j.i + 0.5 AND j.i + 0.5 < y1) c FROM p JOIN k i ON floor(x0) <= i.i AND i.i <= floor(x1) JOIN k j ON floor(y0) <= j.i AND j.i <= floor(y1) GROUP BY ALL)
SELECT a.geoid, count(i) touched, CAST(coalesce(sum(63 - j), 0) AS BIGINT) AS rows, CAST(coalesce(sum(i), 0) AS BIGINT) cols, count(*) FILTER (c) centred FROM a LEFT JOIN t ON a.geoid = t.geoid GROUP BY 1"""


def county_hexagons(spark, d) -> DataFrame:
    """Hexagons of a flat grid whose centre lies in a county."""
    c = fixture(spark, d, "counties")
    scaled = {k: (F.col(k) - o) * 1e5 for k, o in (("minx", -67.5), ("maxx", -67.5), ("miny", 17.9), ("maxy", 17.9))}
    cells = with_box(c.withColumns(scaled)).select("geoid", F.explode(g.hex_cover(F.col("geom"), 700.0)).alias("c"))
    return cells.groupBy("geoid").agg(F.count("*").alias("cells"), F.sum("c.q").alias("q"), F.sum("c.r").alias("r"))


HEXAGON_SQL = """
WITH c AS (SELECT geoid, (minx + 67.5::DOUBLE) * 1e5 x0, (maxx + 67.5::DOUBLE) * 1e5 x1, (miny - 17.9::DOUBLE) * 1e5 y0, (maxy - 17.9::DOUBLE) * 1e5 y1 FROM {counties}),
r AS (SELECT geoid, x0, x1, unnest(range(CAST(ceil(y0 / 1050) AS BIGINT), CAST(ceil(y1 / 1050) AS BIGINT))) r FROM c),
q AS (SELECT geoid, r, unnest(range(CAST(ceil(x0 / (700 * sqrt(3::DOUBLE)) - r / 2) AS BIGINT), CAST(ceil(x1 / (700 * sqrt(3::DOUBLE)) - r / 2) AS BIGINT))) q FROM r)
SELECT geoid, count(*) cells, CAST(sum(q) AS BIGINT) q, CAST(sum(r) AS BIGINT) r FROM q GROUP BY 1"""

def wkt_shapes(spark, d) -> DataFrame:
    """Shapes written as text and read again: text, area, type, and whether they are valid; some are bow ties, some have two parts."""
    k, w, h = F.col("p_partkey"), (F.col("p_size") + 1).cast("double"), F.lit(3.0)
    ring = lambda *pts: F.array(*(g.point_struct(k + x, y) for x, y in [*pts, pts[0]]))
    zero = F.lit(0.0)
    box, tie = ring((zero, zero), (w, zero), (w, h), (zero, h)), ring((zero, zero), (w, h), (w, zero), (zero, h))
    second = ring((w + 1, zero), (w + 2, zero), (w + 2, F.lit(0.5)))
    shape = F.when(k % 3 == 0, _shape(tie)).when(k % 3 == 1, _shape(box, second)).otherwise(_shape(box))
    rows = spread(fixture(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", wkt.to_wkt(shape).alias("text")).withColumn("back", wkt.from_wkt("text"))
    return rows.select("p_partkey", "text", g.area(F.col("back")).alias("area"), wkt.geometry_type(F.col("back")).alias("kind"), wkt.is_valid(F.col("back")).alias("valid"))


WKT_SQL = """
WITH p AS (SELECT p_partkey k, p_partkey + p_size + 1 e FROM part)
SELECT k p_partkey, CASE k % 3 WHEN 0 THEN format('POLYGON (({0} 0, {1} 3, {1} 0, {0} 3, {0} 0))', k, e) WHEN 1 THEN format('MULTIPOLYGON ((({0} 0, {1} 0, {1} 3, {0} 3, {0} 0)), (({2} 0, {3} 0, {3} 0.5, {2} 0)))', k, e, e + 1, e + 2)
  ELSE format('POLYGON (({0} 0, {1} 0, {1} 3, {0} 3, {0} 0))', k, e) END AS text,
  CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 * (e - k) + 0.25 ELSE 3 * (e - k) END::DOUBLE area, CASE WHEN k % 3 = 1 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END kind, k % 3 <> 0 AS valid FROM p"""

_ALL = {
    "county_boundaries": (county_boundaries, COUNTY_SQL),
    "island_area": (island_area, ISLAND_SQL),
    "roof_outlines": (roof_outlines, ROOF_SQL),
    "polygon_relations": (polygon_relations, RELATION_SQL),
    "covered_share": (covered_share, COVER_SQL),
    "array_outlines": (array_outlines, ARRAY_SQL),
    "clip_metrics": (clip_metrics, CLIP_SQL),
    "touched_cells": (touched_cells, TOUCH_SQL),
    "county_hexagons": (county_hexagons, HEXAGON_SQL),
    "wkt_shapes": (wkt_shapes, WKT_SQL),
}

QUERIES = {n: f for n, (f, _) in _ALL.items()}
ORACLE_SQL = {n: sql if n == "wkt_shapes" else expanded(sql) for n, (_, sql) in _ALL.items()}
