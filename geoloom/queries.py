"""Queries over the geography tables, each with SQL for the same rows. Shapes are those of `fixtures`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import SQL, expanded, fixture, with_box
from .functions import geometry as g
from .functions import scalars as s
from .operators import spatial, statistics, tables
from .sources.files import parquet_stream, shared_folder
from .plans import capacity, catalog, census, imagery, manifest
from .streaming import ledger

#: About the width of a building in degrees.
SMALL = 2e-4


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _buildings_in(spark, d, areas: DataFrame, area_id: str) -> DataFrame:
    b = fixture(spark, d, "buildings")
    return spatial.points_within(b, areas, point_id="building_id", area_id=area_id, x="lon", y="lat", cell=0.005, boxes=True)


def pv_by_block_group(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: buildings by block group, with panels, their area, rate, and demographics."""
    b, p, bg = (fixture(spark, d, n) for n in ("buildings", "panels", "block_groups"))
    pairs = spatial.overlap_pairs(b, p, left_id="building_id", right_id="panel_id", cell=SMALL, boxes=True)
    has = spatial.count_and_area(b, pairs, left_id="building_id", count="n_panels", total="panel_area")
    where = _buildings_in(spark, d, bg, "geoid")
    per = has.join(where, "building_id").groupBy("geoid").agg(
        F.count("*").alias("buildings"), F.sum((F.col("n_panels") > 0).cast("int")).alias("with_pv"), F.sum("panel_area").alias("area")
    )
    acs = census.demographic_metrics(fixture(spark, d, "acs"), **ACS)
    out = bg.select("geoid").join(per, "geoid", "left").join(acs, F.col("geoid") == acs.bg_geoid, "left")
    n = F.coalesce("buildings", F.lit(0))
    return out.select(
        "geoid", n.alias("buildings"), F.coalesce("with_pv", F.lit(0)).alias("with_pv"), _r(F.coalesce("area", F.lit(0.0)) * 1e9, 3).alias("pv_area"),
        _r(s.safe_ratio(F.col("with_pv"), n)).alias("pv_rate"), _r(F.col("diversity_index")).alias("diversity"), _r(F.col("owner_share")).alias("owner_share"),
    )


ACS = {"groups": ["g1", "g2", "g3"], "total": "total", "owner": "owners", "tenure": "households", "schooling": ["g2", "g3"], "adults": "total", "poor": "g3", "poverty_base": "total"}
_NUM = "CASE WHEN TRY_CAST({0} AS DOUBLE) > -100000000 THEN TRY_CAST({0} AS DOUBLE) END"
_ACS_SQL = f"""acs AS (SELECT bg_geoid, {", ".join(f"{_NUM.format(c)} AS {c}" for c in ("g1", "g2", "g3", "total", "owners", "households"))}, population FROM {{acs}})"""
_MEET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
_OVER = "greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0)"
_IN = "lon >= minx AND lon < maxx AND lat >= miny AND lat < maxy"
_DIV = "1 - (power(g1 / nullif(total, 0), 2) + power(g2 / nullif(total, 0), 2) + power(g3 / nullif(total, 0), 2))"

PV_SQL = f"""
WITH {_ACS_SQL}, a AS (SELECT * FROM {{buildings}}), b AS (SELECT * FROM {{panels}}),
p AS (SELECT building_id, count(*) n, sum({_OVER}) o FROM a JOIN b ON {_MEET} GROUP BY 1),
x AS (SELECT g.geoid, count(*) buildings, count(p.n) with_pv, sum(coalesce(o, 0)) area FROM a JOIN {{block_groups}} g ON a.lon >= g.minx AND a.lon < g.maxx AND a.lat >= g.miny AND a.lat < g.maxy LEFT JOIN p USING (building_id) GROUP BY 1)
SELECT geoid, coalesce(buildings, 0) buildings, coalesce(with_pv, 0) with_pv, round(coalesce(area, 0) * 1e9, 3) pv_area, round(with_pv / buildings, 6) pv_rate,
  round({_DIV}, 6) diversity, round(owners / nullif(households, 0), 6) owner_share
FROM {{block_groups}} LEFT JOIN x USING (geoid) LEFT JOIN acs ON geoid = bg_geoid"""


def panel_attribution(spark, d) -> DataFrame:
    """Panels to counties: by overlap, over half the panel, and in two stages."""
    p, c = fixture(spark, d, "panels"), fixture(spark, d, "counties").withColumnRenamed("geoid", "county_geoid")
    p = p.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2, "size2": (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))})
    pairs = spatial.overlap_pairs(p, c, left_id="panel_id", right_id="county_geoid", cell=0.02, boxes=True)
    best = spatial.largest_overlap(p, pairs, left_id="panel_id", right_id="county_geoid").select("panel_id", F.col("county_geoid").alias("by_overlap"))
    half = spatial.largest_overlap(p, pairs, left_id="panel_id", right_id="county_geoid", least_share=F.col("overlap") / F.col("size2") > 0.5).select("panel_id", F.col("county_geoid").alias("by_majority"))
    two = spatial.assign_two_stage(p, c, left_id="panel_id", area_id="county_geoid", x="x", y="y", cell=0.02, boxes=True).select("panel_id", F.col("county_geoid").alias("in_two_stages"))
    return best.join(half, "panel_id").join(two, "panel_id")


ATTRIBUTION_SQL = f"""
WITH a AS (SELECT * FROM {{panels}}), b AS (SELECT * FROM {{counties}}),
o AS (SELECT panel_id, geoid, {_OVER} o, (a.maxx - a.minx) * (a.maxy - a.miny) s FROM a JOIN b ON {_MEET}),
r AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY o DESC, geoid) n FROM o),
i AS (SELECT panel_id, min(geoid) geoid FROM a JOIN b ON (a.minx + a.maxx) / 2 >= b.minx AND (a.minx + a.maxx) / 2 < b.maxx AND (a.miny + a.maxy) / 2 >= b.miny AND (a.miny + a.maxy) / 2 < b.maxy GROUP BY 1)
SELECT a.panel_id, r.geoid by_overlap, CASE WHEN r.o / r.s > 0.5 THEN r.geoid END by_majority, coalesce(i.geoid, CASE WHEN r.o > 0 THEN r.geoid END) in_two_stages
FROM a LEFT JOIN r ON a.panel_id = r.panel_id AND n = 1 LEFT JOIN i ON a.panel_id = i.panel_id"""


def polygon_overlap(spark, d) -> DataFrame:
    """The same pairs by the general polygon functions, with areas, centroids and WKB round trips."""
    b, p = with_box(fixture(spark, d, "buildings")), with_box(fixture(spark, d, "panels"))
    pairs = spatial.candidate_pairs(b, p, cell=SMALL).where(g.intersects("l.geom", "r.geom"))
    again = g.from_wkb(g.to_wkb("l.geom"))
    return pairs.select(
        F.col("l.building_id").alias("building_id"), F.col("r.panel_id").alias("panel_id"), _r(g.overlap_area("l.geom", "r.geom") * 1e9, 3).alias("overlap"), _r(g.area(again) * 1e9, 3).alias("area"),
    ).groupBy("building_id").agg(F.count("*").alias("n"), _r(F.sum("overlap"), 2).alias("overlap"), F.max("area").alias("area"))


POLYGON_SQL = f"""
WITH a AS (SELECT * FROM {{buildings}}), b AS (SELECT * FROM {{panels}}), p AS (SELECT building_id, round({_OVER} * 1e9, 3) o, round((a.maxx - a.minx) * (a.maxy - a.miny) * 1e9, 3) s FROM a JOIN b ON {_MEET})
SELECT building_id, count(*) n, round(sum(o), 2) overlap, max(s) area FROM p GROUP BY 1"""


def tag_filter(spark, d) -> DataFrame:
    """Panels by tags, some of which the table hasn't, and how many of each county's are left."""
    p = fixture(spark, d, "panels")
    text = lambda n: s.text_or_empty(p.columns, n)
    kept = p.where((text("kind").contains("brass") | (text("method") == "photovoltaic")) & ~text("content").isin("water", "hot_water") & (F.col("size") % 11 != 0))
    c = fixture(spark, d, "counties").withColumnRenamed("geoid", "county_geoid")
    pairs = spatial.overlap_pairs(kept, c, left_id="panel_id", right_id="county_geoid", cell=0.02, boxes=True)
    n = pairs.groupBy("county_geoid").agg(F.count("*").alias("panels"))
    return c.join(n, "county_geoid", "left").select("county_geoid", F.coalesce("panels", F.lit(0)).alias("panels"))


TAG_SQL = f"""
WITH a AS (SELECT * FROM {{panels}} WHERE contains(lower(kind), 'brass') AND size % 11 <> 0), b AS (SELECT * FROM {{counties}})
SELECT b.geoid county_geoid, count(a.panel_id) panels FROM b LEFT JOIN a ON {_MEET} GROUP BY 1"""


def occupied_cells(spark, d) -> DataFrame:
    """Hexagons with buildings, their dominant class, and totals per class."""
    cells = manifest.occupied_cells(fixture(spark, d, "buildings"), lon="lon", lat="lat", name="class", edge_m=4000.0)
    return cells.groupBy("class").agg(F.count("*").alias("cells"), F.sum("building_count").alias("buildings"), F.sum(F.col("crosses_boundary").cast("int")).alias("crossing"))


def _hexagon_sql(edge_m: float) -> str:
    """SQL for the hexagon (q, r) of each building: UTM by the series that `to_utm` names, then cube rounding."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    size = 6_378_137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    num = lambda v: f"{v!r}::DOUBLE"
    north = " + ".join(f"sin({2 * j} * xi) * cosh({2 * j} * eta) * {num(c)}" for j, c in enumerate(series, 1))
    east = " + ".join(f"cos({2 * j} * xi) * sinh({2 * j} * eta) * {num(c)}" for j, c in enumerate(series, 1))
    return f"""
h0 AS (SELECT class, sin(radians(lat)) s, radians(lon + 69) a FROM {{buildings}}),
h1 AS (SELECT class, sinh(atanh(s) - atanh(s * {num(k)}) * {num(k)}) t, a FROM h0),
h2 AS (SELECT class, atan2(t, cos(a)) xi, atanh(sin(a) / sqrt(t * t + 1)) eta FROM h1),
h3 AS (SELECT class, (eta + {east}) * {num(size)} + 500000 x, (xi + {north}) * {num(size)} y FROM h2),
h4 AS (SELECT class, (x * sqrt(3) / 3 - y / 3) / {num(edge_m)} q, y * 2 / 3 / {num(edge_m)} r FROM h3),
h5 AS (SELECT class, q, r, round(q) a, round(r) b, round(-q - r) c FROM h4),
h6 AS (SELECT class, a, b, c, abs(a - q) da, abs(b - r) db, abs(c + q + r) dc FROM h5),
hexagons AS (SELECT class, CASE WHEN da > db AND da > dc THEN -b - c ELSE a END q, CASE WHEN da > db AND da > dc THEN b WHEN db > dc THEN -a - c ELSE b END r FROM h6)"""


CELLS_SQL = f"""
WITH {_hexagon_sql(4000.0)},
n AS (SELECT q, r, class, count(*) n FROM hexagons GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY n DESC, class) i, sum(n) OVER (PARTITION BY q, r) t FROM n)
SELECT class, count(*) cells, CAST(sum(t) AS BIGINT) buildings, count(*) FILTER (t > n) crossing FROM k WHERE i = 1 GROUP BY 1"""


def grid_dominant(spark, d) -> DataFrame:
    """The dominant class per square cell, by the same operator as for hexagons."""
    b = fixture(spark, d, "buildings").withColumns({"i": F.floor(F.col("lon") / 0.05), "j": F.floor(F.col("lat") / 0.05)})
    return spatial.dominant_per_cell(b, cell=["i", "j"], name="class")


GRID_SQL = """
WITH n AS (SELECT CAST(floor(lon / 0.05::DOUBLE) AS BIGINT) i, CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) j, class, count(*) n FROM {buildings} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY n DESC, class) k, sum(n) OVER (PARTITION BY i, j) t FROM n)
SELECT i, j, class, n dominant_count, CAST(t AS BIGINT) building_count, t > n crosses_boundary FROM r WHERE k = 1"""


def urban_rollup(spark, d) -> DataFrame:
    """Urban blocks by block group, tract and county, summed up to counts of rows and ratios."""
    bg, blocks, acs = (fixture(spark, d, n) for n in ("block_groups", "blocks", "acs"))
    urban = blocks.where(F.col("id") % 3 != 0)
    levels = {}
    for name in ("block_group", "tract", "county"):
        areas = bg.groupBy(census.parent(F.col("geoid"), name).alias("geoid")).agg(F.sum("land_m2").alias("land_m2"))
        levels[name] = census.urban_rollup(areas, urban, acs, name=name)
    q = census.rollup_quality(levels)
    return q.withColumns({"median_ratio": _r(F.col("median_ratio")), "max_ratio": _r(F.col("max_ratio"))})


URBAN_SQL = "WITH g AS (SELECT geoid, land_m2 FROM {block_groups}), b AS (SELECT * FROM {blocks} WHERE id % 3 <> 0), a AS (SELECT bg_geoid, population FROM {acs})" + " UNION ALL ".join(
    f"""
SELECT '{name}' AS level, count(*) AS rows, coalesce(sum(CAST(n > 0 AS INT)), 0)::BIGINT urban_rows, coalesce(sum(CAST(pop / people > 1 AS INT)), 0)::BIGINT above_one, round(median(pop / people), 6) median_ratio, round(max(pop / people), 6) max_ratio
FROM (SELECT DISTINCT left(geoid, {k}) geoid FROM g) LEFT JOIN (SELECT left(block_geoid, {k}) geoid, count(*) n FROM b GROUP BY 1) USING (geoid)
LEFT JOIN (SELECT left(geoid, {k}) geoid, coalesce(p, 0) pop FROM g LEFT JOIN (SELECT left(block_geoid, {k}) q, sum(pop) p FROM b GROUP BY 1) ON q = left(geoid, {k}) GROUP BY ALL) USING (geoid)
LEFT JOIN (SELECT left(bg_geoid, {k}) geoid, sum(population) people FROM a GROUP BY 1) USING (geoid)"""
    for name, k in (("block_group", 12), ("tract", 11), ("county", 5))
)


def vintages(spark, d) -> DataFrame:
    """Statuses of two vintages of blocks, with shares of the total."""
    old = fixture(spark, d, "blocks").withColumnRenamed("block_geoid", "geoid")
    status = census.vintage_comparison(old, fixture(spark, d, "blocks_later"))
    counts = status.groupBy("status").agg(F.count("*").alias("n"), _r(F.min("old_share"), 5).alias("least_share"), _r(F.max("distance_m"), 2).alias("farthest_m"))
    return tables.share_of_total(counts)


_HAV = "2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2))))"
VINTAGE_SQL = f"""
WITH a AS (SELECT * FROM {{blocks}}), b AS (SELECT * FROM {{blocks_later}}),
j AS (SELECT a.block_geoid ag, b.geoid bg, a.minx = b.minx AND a.miny = b.miny AND a.maxx = b.maxx AND a.maxy = b.maxy same, {_OVER} o, (a.maxx - a.minx) * (a.maxy - a.miny) sa, (b.maxx - b.minx) * (b.maxy - b.miny) sb,
  (a.minx + a.maxx) / 2 x1, (a.miny + a.maxy) / 2 y1, (b.minx + b.maxx) / 2 x2, (b.miny + b.maxy) / 2 y2 FROM a FULL JOIN b ON a.block_geoid = b.geoid),
s AS (SELECT CASE WHEN ag IS NULL THEN 'new' WHEN bg IS NULL THEN 'missing' WHEN same THEN 'exact' WHEN o / sa >= 0.999 AND o / sb >= 0.999 THEN 'near' ELSE 'changed' END status,
  CASE WHEN ag IS NOT NULL AND bg IS NOT NULL THEN o / sa END os, CASE WHEN ag IS NOT NULL AND bg IS NOT NULL THEN {_HAV} END dm FROM j)
SELECT status, count(*) n, round(min(os), 5) least_share, round(max(dm), 2) farthest_m, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 3) pct FROM s GROUP BY 1"""


def zonal(spark, d) -> DataFrame:
    """Pixel statistics per zone."""
    out = statistics.zonal_stats(fixture(spark, d, "pixels"), "zone")
    return out.select("zone", "pixel_count", *(_r(F.col(c), 6).alias(c) for c in ("mean", "p10", "p90", "pooled_p10", "pooled_p90")))


ZONAL_SQL = """
WITH t AS (SELECT zone, tile_id, avg(value) m, quantile_cont(value, 0.1) a, quantile_cont(value, 0.9) b, count(*) n FROM {pixels} WHERE value IS NOT NULL GROUP BY 1, 2),
p AS (SELECT zone, quantile_cont(value, 0.1) a, quantile_cont(value, 0.9) b FROM {pixels} WHERE value IS NOT NULL GROUP BY 1)
SELECT t.zone, CAST(sum(n) AS BIGINT) pixel_count, round(sum(m * n) / sum(n), 6) mean, round(sum(t.a * n) / sum(n), 6) p10, round(sum(t.b * n) / sum(n), 6) p90, round(any_value(p.a), 6) pooled_p10, round(any_value(p.b), 6) pooled_p90
FROM t JOIN p ON t.zone = p.zone GROUP BY 1"""


def value_classes(spark, d) -> DataFrame:
    """Buildings by quintile of height, and the range that a map would show."""
    b = fixture(spark, d, "buildings").select("building_id", "class", F.col("height").cast("double").alias("height"))
    out = statistics.quantile_class(b, "height")
    q = statistics.percentiles(out, "height", [0.05, 0.5, 0.9, 0.95], ["quantile_class"])
    all_ = out.groupBy("quantile_class").agg(F.count("*").alias("n"), *(f("height").alias(f.__name__) for f in (F.min, F.max)), F.avg("height").alias("mean"), F.count("height").alias("known"))
    many = lambda i, c: F.when(F.col("known") >= 10, F.col("q")[i]).otherwise(F.col(c))
    wanted = {"low": many(0, "min"), "high": many(3, "max"), "min": F.col("min"), "mean": F.col("mean"), "p50": F.col("q")[1], "p90": F.col("q")[2], "max": F.col("max")}
    return all_.join(q, all_.quantile_class.eqNullSafe(q.quantile_class), "left").select(all_.quantile_class, "n", *(_r(c, 3).alias(n) for n, c in wanted.items()))


CLASS_SQL = """
WITH b AS (SELECT CAST(height AS DOUBLE) h FROM {buildings}), q AS (SELECT quantile_cont(h, [0.2, 0.4, 0.6, 0.8]) q FROM b),
c AS (SELECT h, CAST(len(list_filter(q, lambda x: h > x)) AS INTEGER) quantile_class FROM b, q)
SELECT quantile_class, count(*) n, round(CASE WHEN count(*) >= 10 THEN quantile_cont(h, 0.05) ELSE min(h) END, 3) low, round(CASE WHEN count(*) >= 10 THEN quantile_cont(h, 0.95) ELSE max(h) END, 3) high,
  round(min(h), 3) min, round(avg(h), 3) mean, round(quantile_cont(h, 0.5), 3) p50, round(quantile_cont(h, 0.9), 3) p90, round(max(h), 3) max FROM c GROUP BY 1"""


def morans(spark, d) -> DataFrame:
    """Moran's I of population over block groups that touch, per county."""
    bg = with_box(fixture(spark, d, "block_groups"))
    values = bg.join(fixture(spark, d, "acs").select(F.col("bg_geoid").alias("geoid"), "population"), "geoid")
    edges = spatial.contiguity(bg, area_id="geoid")
    out = statistics.morans_i(values, edges, area_id="geoid", value="population", by="county_geoid")
    return out.select("county_geoid", "n", _r(F.col("moran_i")).alias("moran_i"))


MORAN_SQL = """
WITH v AS (SELECT g.*, a.population p, avg(a.population) OVER (PARTITION BY county_geoid) m FROM {block_groups} g JOIN {acs} a ON a.bg_geoid = g.geoid),
e AS (SELECT a.county_geoid c, a.geoid, a.p - a.m za, b.p - b.m zb, 1.0 / count(*) OVER (PARTITION BY a.geoid) w FROM v a JOIN v b ON a.county_geoid = b.county_geoid AND a.geoid <> b.geoid
  AND abs(a.minx - b.minx) < 1.05 * (a.maxx - a.minx) AND abs(a.miny - b.miny) < 0.035),
n AS (SELECT county_geoid c, count(*) n, sum((p - m) * (p - m)) zz FROM v GROUP BY 1)
SELECT n.c county_geoid, n.n, round(n.n * sum(w * za * zb) / (sum(w) * any_value(zz)), 6) moran_i FROM e JOIN n ON e.c = n.c WHERE n.n >= 5 GROUP BY 1, 2"""


def quarters(spark, d) -> DataFrame:
    """Quarterly series with labels and growth."""
    m = fixture(spark, d, "capacity").select("period", (F.col("kw").cast("double") / 1000).alias("capacity_mw"), "client_count")
    q = capacity.quarterly(m)
    day = lambda c: F.col(c).cast("string").alias(c)
    return q.select(
        day("period"), "quarter_key", "quarter_label", day("quarter_start"), day("quarter_end"), "is_year_end", _r(F.col("capacity_mw")).alias("mw"), _r(F.col("capacity_delta_mw")).alias("delta"),
        _r(F.col("capacity_growth_pct")).alias("pct"), F.col("client_delta").cast("double").alias("client_delta"),
    )


QUARTER_SQL = """
WITH m AS (SELECT *, CAST(kw AS DOUBLE) / 1000 mw, CAST(date_trunc('quarter', period) AS DATE) s FROM {capacity}),
q AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY period DESC) n FROM m)
SELECT CAST(period AS VARCHAR) period, year(period) || '-Q' || quarter(period) quarter_key, 'Q' || quarter(period) || ' ' || year(period) quarter_label, CAST(s AS VARCHAR) quarter_start, CAST(CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) quarter_end,
  quarter(period) = 4 is_year_end, round(mw, 6) mw, round(mw - lag(mw) OVER (ORDER BY q.period), 6) delta, round((mw - lag(mw) OVER (ORDER BY q.period)) * 100 / lag(mw) OVER (ORDER BY q.period), 6) pct,
  CAST(client_count - lag(client_count) OVER (ORDER BY q.period) AS DOUBLE) client_delta
FROM q WHERE n = 1"""


def ledger_spend(spark, d) -> DataFrame:
    """Paid calls and cost, per day of the ledger."""
    out = manifest.ledger_summary(fixture(spark, d, "ledger").withColumn("day", F.to_date("ts").cast("string")), ["day"], free=20, cap=50)
    return out


SPEND_SQL = """
WITH c AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) entries, CAST(count(*) FILTER (endpoint = 'layers' AND status = 'ok' AND NOT cache_hit) AS BIGINT) calls FROM {ledger} GROUP BY 1)
SELECT *, least(calls, 20) free_used, greatest(20 - calls, 0) free_left, greatest(calls - 20, 0) billable, greatest(50 - calls, 0) left_to_cap, round(greatest(calls - 20, 0) * 0.075::DOUBLE, 3) cost_usd FROM c"""


def latest_status(spark, d) -> DataFrame:
    """Tiles with the latest terminal status; those with none keep theirs."""
    led = fixture(spark, d, "ledger")
    tiles = led.select("tile_id").distinct().withColumn("status", F.lit("pending"))
    return manifest.promoted(tiles, led).groupBy("status").agg(F.count("*").alias("tiles"), F.sum("tile_id").alias("key_sum"))


STATUS_SQL = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, status) n FROM {ledger} WHERE status IN ('ok', 'not_found')), t AS (SELECT DISTINCT tile_id FROM {ledger})
SELECT coalesce(status, 'pending') AS status, count(*) tiles, CAST(sum(t.tile_id) AS BIGINT) key_sum FROM t LEFT JOIN l ON l.tile_id = t.tile_id AND n = 1 GROUP BY 1"""


def budget_cut(spark, d) -> DataFrame:
    """The ledger's tiles in order of priority while calls that count stay below a cap."""
    led = fixture(spark, d, "ledger").withColumn("priority", F.col("tile_id") % 4)
    cost = ((F.col("status") == "ok") & (F.col("endpoint") == "layers")).cast("int")
    kept = manifest.within_budget(led, ["priority", "event_id"], cost, 200)
    return kept.groupBy("priority").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


BUDGET_SQL = """
WITH l AS (SELECT event_id, tile_id % 4 priority, CAST(status = 'ok' AND endpoint = 'layers' AS INT) c FROM {ledger}),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY priority, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM l)
SELECT priority, count(*) n, max(event_id) last_id FROM r WHERE b < 200 GROUP BY 1"""


def probe_points(spark, d) -> DataFrame:
    """A sample of buildings spread over each class's order: few from each of eight runs."""
    b = fixture(spark, d, "buildings")
    return tables.balanced_sample(b, "class", [F.col("lon"), F.col("building_id")], 8, 6).select("building_id", "class", "bucket")


PROBE_SQL = """
WITH n AS (SELECT building_id, class, lon, ntile(8) OVER (PARTITION BY class ORDER BY lon, building_id) bucket FROM {buildings}),
r AS (SELECT *, row_number() OVER (PARTITION BY class, bucket ORDER BY lon, building_id) k FROM n) SELECT building_id, class, CAST(bucket AS INTEGER) bucket FROM r WHERE k <= 6"""


def first_known(spark, d) -> DataFrame:
    """Per tile and column the first known value of the ledger, best status first, then latest."""
    led = fixture(spark, d, "ledger").withColumns({"quality": F.when(F.col("event_id") % 3 == 0, "HIGH").when(F.col("event_id") % 3 == 1, "LOW"), "imagery_date": F.when(F.col("event_id") % 5 > 0, F.to_date("ts"))})
    out = manifest.collapsed_probe(led)
    return out.groupBy("quality").agg(F.count("*").alias("tiles"), F.min("imagery_date").cast("string").alias("earliest"), F.max("imagery_date").cast("string").alias("latest"))


KNOWN_SQL = """
WITH l AS (SELECT tile_id, status, CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END quality, CASE WHEN event_id % 5 > 0 THEN CAST(ts AS DATE) END d FROM {ledger}),
k AS (SELECT *, CASE quality WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 2 ELSE 4 END q FROM l),
o AS (SELECT tile_id, first(quality ORDER BY q, d DESC NULLS LAST, status) FILTER (quality IS NOT NULL) quality, first(d ORDER BY q, d DESC NULLS LAST, status) FILTER (d IS NOT NULL) d FROM k GROUP BY 1)
SELECT quality, count(*) tiles, CAST(min(d) AS VARCHAR) earliest, CAST(max(d) AS VARCHAR) latest FROM o GROUP BY 1"""


def url_functions(spark, d) -> DataFrame:
    """Link functions over page URLs."""
    p = fixture(spark, d, "pages")
    u = F.col("url")
    return p.select(
        "page_id", s.query_value(u, "page").alias("page"), s.resolve_href(u, F.lit("../x/item.json")).alias("up"), s.resolve_href(u, F.lit("/root.json")).alias("top"), s.resolve_href(u, F.lit("../../../../../../../x/./y/../z.json?a=../b")).alias("deep"), s.slug(F.regexp_extract(u, "://([^/]*)", 1)).alias("slug"),
    )


URL_SQL = """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) r, regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^([^?#]*/)', 1) f FROM pages)
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') page, r || regexp_replace(CASE WHEN f = '' THEN '/' ELSE f END, '[^/]+/$', '') || 'x/item.json' up, r || '/root.json' top, r || '/x/z.json?a=../b' deep,
  replace(trim(regexp_replace(lower(regexp_extract(url, '://([^/]*)', 1)), '[^a-z0-9]+', ' ', 'g')), ' ', '_') slug FROM p"""


def item_catalog(spark, d) -> DataFrame:
    """Catalog items of parts: nested properties, an asset ladder, a box, and one row per (source, item)."""
    items = fixture(spark, d, "part").select(
        (F.col("p_partkey") % 500).cast("string").alias("id"), F.create_map(F.lit("gsd"), (F.col("p_size") / 100.0).cast("string"), F.lit("proj:epsg"), F.lit("EPSG:3857"), F.lit("datetime"), F.concat(F.lit("2020-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).alias("properties"),
        F.array(*(F.col("p_size").cast("double") + i for i in range(4))).alias("bbox"),
        F.array(
            F.struct(F.lit("thumbnail").alias("name"), F.lit("t.png").alias("href"), F.lit("preview").alias("title"), F.array(F.lit("thumbnail")).alias("roles")),
            F.struct(F.when(F.col("p_size") % 2 == 0, "visual").otherwise("b1").alias("name"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("href"), F.lit("image").alias("title"), F.array(F.lit("data")).alias("roles")),
        ).alias("assets"),
    )
    rows = catalog.normalised_items(items, "parts", exact=["visual"], roles=["data"], keywords=["tif"], blocked=["preview"])
    rows = tables.first_per(rows, ["source", "item_id"], [F.desc_nulls_last("acquired"), F.asc("asset_href")])
    return rows.select("source", "item_id", F.to_date("acquired").cast("string").alias("day"), "minx", "maxy", "asset_role", "asset_href", _r(F.col("gsd_m"), 4).alias("gsd_m"), "epsg", "asset_names")


ITEM_SQL = """
WITH p AS (SELECT CAST(p_partkey % 500 AS VARCHAR) item_id, DATE '2020-01-01' + CAST(p_partkey % 28 AS INTEGER) AS day, CAST(p_size AS DOUBLE) minx, CAST(p_size + 3 AS DOUBLE) maxy, CASE WHEN p_size % 2 = 0 THEN 'visual' ELSE 'b1' END asset_role,
  'f' || p_partkey || '.tif' asset_href, round(p_size / 100.0::DOUBLE, 4) gsd_m, CASE WHEN p_size % 2 = 0 THEN '["thumbnail","visual"]' ELSE '["b1","thumbnail"]' END asset_names FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY day DESC, asset_href) n FROM p)
SELECT 'parts' AS source, item_id, CAST(day AS VARCHAR) AS day, minx, maxy, asset_role, asset_href, gsd_m, 3857 epsg, asset_names FROM r WHERE n = 1"""


def resolutions(spark, d) -> DataFrame:
    """Suppliers' items by resolution, as text, per nation."""
    c = fixture(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.abs("s_acctbal") / 100).alias("cm"), F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")).alias("source"))
    return catalog.resolution_summary(c, "nation")


RESOLUTION_SQL = """
WITH c AS (SELECT s_nationkey nation, CASE WHEN abs(s_acctbal) / 100 < 45 THEN 30 ELSE 60 END b, 's' || (s_suppkey % 3) source FROM supplier),
n AS (SELECT nation, b, count(*) n FROM c GROUP BY 1, 2)
SELECT nation, (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT source s FROM c c2 WHERE c2.nation = n.nation)) sources, string_agg(n || ' : ~' || b || ' cm', chr(10) ORDER BY b) resolutions FROM n GROUP BY nation"""


def coverage_report(spark, d) -> DataFrame:
    """Block groups with and without usable demographics, per county."""
    bg = fixture(spark, d, "block_groups")
    usable = fixture(spark, d, "acs").where(s.without_sentinel(s.numeric(F.col("g1"))).isNotNull()).select(F.col("bg_geoid").alias("geoid"))
    return tables.coverage(bg, usable, ["geoid"], ["county_geoid"])


COVERAGE_SQL = f"""
WITH a AS (SELECT bg_geoid FROM {{acs}} WHERE ({_NUM.format("g1")}) IS NOT NULL)
SELECT county_geoid, count(*) AS rows, count(bg_geoid) matched, count(*) - count(bg_geoid) missing FROM {{block_groups}} LEFT JOIN a ON bg_geoid = geoid GROUP BY 1"""


def label_counts(spark, d) -> DataFrame:
    """Words of part names as labels: which have some tokens and not others."""
    label = s.normal_label(F.concat_ws(" ", "p_name", "p_type"))
    rows = fixture(spark, d, "part").select(s.has_tokens(label, ["brass"], ["small"]).alias("kept"), "p_size")
    return rows.groupBy("kept").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


LABEL_SQL = """
WITH p AS (SELECT string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ') w, p_size FROM part)
SELECT list_contains(w, 'brass') AND NOT list_contains(w, 'small') kept, count(*) n, CAST(sum(p_size) AS BIGINT) sizes FROM p GROUP BY 1"""


def grid_tiles(spark, d) -> DataFrame:
    """Tiles of a regular grid whose disk meets a block group."""
    c = fixture(spark, d, "block_groups")
    return manifest.grid_tiles(c, area_id="geoid", spacing=0.015625, radius=0.0078125).groupBy("geoid").agg(F.count("*").alias("tiles"), F.max("tile_id").alias("last_tile"))


TILE_SQL = """
WITH g AS (SELECT geoid, minx, miny, maxx, maxy, unnest(range(CAST(floor((minx - 0.0078125) / 0.015625) AS BIGINT), CAST(ceil((maxx + 0.0078125) / 0.015625) AS BIGINT) + 1)) i FROM {block_groups}),
h AS (SELECT *, unnest(range(CAST(floor((miny - 0.0078125) / 0.015625) AS BIGINT), CAST(ceil((maxy + 0.0078125) / 0.015625) AS BIGINT) + 1)) j FROM g),
k AS (SELECT geoid FROM h WHERE power(greatest(minx - i * 0.015625::DOUBLE, 0, i * 0.015625::DOUBLE - maxx), 2) + power(greatest(miny - j * 0.015625::DOUBLE, 0, j * 0.015625::DOUBLE - maxy), 2) <= 0.0078125 * 0.0078125)
SELECT geoid, count(*) tiles, geoid || '_t' || lpad(CAST(count(*) - 1 AS VARCHAR), 4, '0') last_tile FROM k GROUP BY 1"""


def stream_spend(spark, d) -> DataFrame:
    """Paid calls per tile group from the ledger read as a stream, drained. The table may be a file or a folder of files."""
    name = f"spend_{uuid.uuid4().hex}"
    rows = spark.sql(SQL["ledger"], events=parquet_stream(spark, f"{d}/events.parquet")).withColumn("part", F.col("tile_id") % 10)
    return ledger.drain(ledger.running_spend(rows, ["part"]), name, f"{shared_folder(spark)}/{name}")


STREAM_SQL = """
WITH c AS (SELECT tile_id % 10 part, count(*) entries, CAST(count(*) FILTER (endpoint = 'layers' AND status = 'ok' AND NOT cache_hit) AS BIGINT) calls FROM {ledger} GROUP BY 1)
SELECT *, least(calls, 1000) free_used, greatest(1000 - calls, 0) free_left, greatest(calls - 1000, 0) billable, greatest(1999 - calls, 0) left_to_cap, round(greatest(calls - 1000, 0) * 0.075::DOUBLE, 3) cost_usd FROM c"""


def labelled_chips(spark, d) -> DataFrame:
    """Chips around buildings with the panels' cells in them."""
    b = fixture(spark, d, "buildings")
    chips = b.select("building_id", *(c.alias(n) for n, c in imagery.chip_bounds(F.col("lon"), F.col("lat"), F.lit(4e-4)).items()))
    return imagery.chip_labels(chips, fixture(spark, d, "panels"), chip_id="building_id", polygon_id="panel_id", cells=32, cell=4e-4, boxes=True)


CHIP_SQL = f"""
WITH a AS (SELECT building_id, lon - 4e-4 / 2 minx, lat - 4e-4 / 2 miny, lon + 4e-4 / 2 maxx, lat + 4e-4 / 2 maxy FROM {{buildings}}), b AS (SELECT * FROM {{panels}}),
p AS (SELECT building_id, panel_id, a.minx ax, a.maxx bx, a.miny ay, a.maxy by_, b.* EXCLUDE (panel_id) FROM a JOIN b ON {_MEET}),
g AS (SELECT *, unnest(range(0, 32)) c FROM p), h AS (SELECT *, unnest(range(0, 32)) r FROM g WHERE ax + (c + 0.5::DOUBLE) * ((bx - ax) / 32) >= minx AND ax + (c + 0.5::DOUBLE) * ((bx - ax) / 32) < maxx),
n AS (SELECT building_id, count(DISTINCT (r, c)) labelled_cells FROM h WHERE by_ - (r + 0.5::DOUBLE) * ((by_ - ay) / 32) >= miny AND by_ - (r + 0.5::DOUBLE) * ((by_ - ay) / 32) < maxy GROUP BY 1)
SELECT building_id, polygons, labelled_cells FROM n JOIN (SELECT building_id, count(DISTINCT panel_id) polygons FROM p GROUP BY 1) USING (building_id)"""


def scorecard(spark, d) -> DataFrame:
    """Counties with buildings, panels and urban blocks, zero-filled, and the share of block groups with buildings."""
    c, bg = fixture(spark, d, "counties"), fixture(spark, d, "block_groups")
    b = fixture(spark, d, "buildings")
    inside = _buildings_in(spark, d, c, "geoid").groupBy("geoid").agg(F.count("*").alias("buildings"))
    urban = fixture(spark, d, "blocks").where(F.col("id") % 3 != 0).groupBy(census.parent(F.col("block_geoid"), "county").alias("geoid")).agg(F.sum("pop").alias("urban_pop"))
    with_b = spatial.flag_intersecting(bg, spatial.points_within(b, bg, point_id="building_id", area_id="geoid", x="lon", y="lat", cell=0.005, boxes=True), left_id="geoid", flag="has")
    share = with_b.groupBy(F.col("county_geoid").alias("geoid")).agg(F.sum(F.col("has").cast("int")).alias("block_groups_with"))
    return imagery.scorecard(c.select("geoid", "name"), "geoid", [inside, urban, share])


SCORE_SQL = """
SELECT c.geoid, c.name, (SELECT count(*) FROM {buildings} b WHERE b.lon >= c.minx AND b.lon < c.maxx AND b.lat >= c.miny AND b.lat < c.maxy) buildings,
  coalesce((SELECT CAST(sum(pop) AS BIGINT) FROM {blocks} k WHERE id % 3 <> 0 AND left(block_geoid, 5) = c.geoid), 0) urban_pop,
  (SELECT count(DISTINCT g.geoid) FROM {block_groups} g JOIN {buildings} b ON b.lon >= g.minx AND b.lon < g.maxx AND b.lat >= g.miny AND b.lat < g.maxy WHERE g.county_geoid = c.geoid) block_groups_with
FROM {counties} c"""


def metric_gaps(spark, d) -> DataFrame:
    """Medians and missing values of demographic estimates per county."""
    a = fixture(spark, d, "acs").withColumns({c: s.without_sentinel(s.numeric(F.col(c))) for c in ("g1", "g2")})
    a = a.withColumn("county_geoid", census.parent(F.col("bg_geoid"), "county"))
    return imagery.missing_and_median(a, "county_geoid", ["g1", "g2"])


GAP_SQL = f"""
WITH a AS (SELECT left(bg_geoid, 5) county_geoid, {_NUM.format("g1")} g1, {_NUM.format("g2")} g2 FROM {{acs}}),
e AS (SELECT county_geoid, 'g1' metric, g1 v FROM a UNION ALL SELECT county_geoid, 'g2', g2 FROM a)
SELECT county_geoid, metric, median(v) median, count(*) - count(v) missing FROM e GROUP BY 1, 2"""


def order_years(spark, d) -> DataFrame:
    """Orders by year and priority, wide."""
    return imagery.year_pivot(fixture(spark, d, "orders").select("o_orderpriority", "o_orderdate"), "o_orderpriority", "o_orderdate", list(range(1992, 2003)))


YEAR_SQL = f"""
WITH c AS (SELECT o_orderpriority, {", ".join(f'count(*) FILTER (year(o_orderdate) = {y}) "{y}"' for y in range(1992, 2003))}, count(*) total FROM orders GROUP BY 1)
SELECT * EXCLUDE (total), total, round(total * 100.0::DOUBLE / sum(total) OVER (), 3) pct FROM c"""


_ALL = {
    "pv_by_block_group": (pv_by_block_group, PV_SQL),
    "panel_attribution": (panel_attribution, ATTRIBUTION_SQL),
    "polygon_overlap": (polygon_overlap, POLYGON_SQL),
    "tag_filter": (tag_filter, TAG_SQL),
    "occupied_cells": (occupied_cells, CELLS_SQL),
    "grid_dominant": (grid_dominant, GRID_SQL),
    "urban_rollup": (urban_rollup, URBAN_SQL),
    "vintages": (vintages, VINTAGE_SQL),
    "zonal": (zonal, ZONAL_SQL),
    "value_classes": (value_classes, CLASS_SQL),
    "morans": (morans, MORAN_SQL),
    "quarters": (quarters, QUARTER_SQL),
    "ledger_spend": (ledger_spend, SPEND_SQL),
    "latest_status": (latest_status, STATUS_SQL),
    "budget_cut": (budget_cut, BUDGET_SQL),
    "probe_points": (probe_points, PROBE_SQL),
    "first_known": (first_known, KNOWN_SQL),
    "url_functions": (url_functions, URL_SQL),
    "item_catalog": (item_catalog, ITEM_SQL),
    "resolutions": (resolutions, RESOLUTION_SQL),
    "coverage_report": (coverage_report, COVERAGE_SQL),
    "label_counts": (label_counts, LABEL_SQL),
    "grid_tiles": (grid_tiles, TILE_SQL),
    "stream_spend": (stream_spend, STREAM_SQL),
    "labelled_chips": (labelled_chips, CHIP_SQL),
    "scorecard": (scorecard, SCORE_SQL),
    "metric_gaps": (metric_gaps, GAP_SQL),
    "order_years": (order_years, YEAR_SQL),
}

QUERIES = {n: f for n, (f, _) in _ALL.items()}
ORACLE_SQL = {n: expanded(sql) for n, (_, sql) in _ALL.items() if sql}
