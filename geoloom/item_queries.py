"""Queries over catalogs, places, labels and streams, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import expanded, fixture, with_box
from .functions import geometry as g
from .functions import scalars as s
from .operators import statistics, tables
from .operators.spatial import areas_of, assign_any, contiguity, points_within
from .plans import catalog, census, rooftops
from .sources import files
from .sources.files import parquet_stream, shared_folder
from .streaming import budget


def _r(c, digits: int = 6):
    return F.round(c, digits)


def newest_items(spark, d) -> DataFrame:
    """Items with a nested box that meet an area, by a newest-first scan: how many of each time, those without one too."""
    o = fixture(spark, d, "orders")
    at = (F.col("o_orderkey") * 7919) % 1009 / 100.0
    box = {"minx": at, "miny": F.lit(0.0), "maxx": at + 0.5, "maxy": F.lit(1.0)}
    items = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("string")).alias("datetime"), F.struct(*(c.alias(n) for n, c in zip(("xmin", "ymin", "xmax", "ymax"), box.values()))).alias("bbox"), g.box(*box.values()).alias("geom"))
    area = g.box(*(F.lit(v) for v in (2.0, 0.25, 4.0, 0.75)))
    found = files.exact_scan(items, (2.0, 0.25, 4.0, 0.75), area)
    days = found.groupBy("datetime").agg(F.count("*").alias("items"), F.min("o_orderkey").alias("first_key"))
    return days.select("datetime", "items", "first_key")


NEWEST_SQL = """
SELECT CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS VARCHAR) END datetime, count(*) items, min(o_orderkey) first_key
FROM orders WHERE (o_orderkey * 7919) % 1009 / 100.0::DOUBLE <= 4 AND (o_orderkey * 7919) % 1009 / 100.0::DOUBLE + 0.5 >= 2 GROUP BY 1"""


def canonical_nested(spark, d) -> DataFrame:
    """Nested items as JSON with keys in order at any depth, NaN and infinities null."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = fixture(spark, d, "part").select(
        k, F.create_map(F.lit("b"), n / 2, F.lit("a"), F.when(n % 3 == 0, F.lit(float("nan"))).otherwise(k / 2)).alias("m"),
        F.struct(F.when(n % 5 == 0, F.lit(float("inf"))).otherwise(F.lit(1.5)).alias("z"), F.array(F.lit(float("nan")), n.cast("double")).alias("y")).alias("s"), F.when(n % 2 == 0, F.col("p_brand")).alias("brand"),
    )
    return p.select("p_partkey", s.canonical_json({c: F.col(c) for c in ("s", "m", "brand")}, of=p).alias("item"))


NESTED_SQL = """
SELECT p_partkey, '{"brand":' || CASE WHEN p_size % 2 = 0 THEN '"' || p_brand || '"' ELSE 'null' END || ',"m":{"a":' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE CAST(p_partkey / 2::DOUBLE AS VARCHAR) END || ',"b":' || CAST(p_size / 2::DOUBLE AS VARCHAR)
  || '},"s":{"y":[null,' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || '],"z":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '1.5' END || '}}' item FROM part"""


def folded_labels(spark, d) -> DataFrame:
    """Whole texts as labels: case folded, without marks, other characters a blank."""
    return fixture(spark, d, "documents").select("doc_id", F.sha2(s.normal_label(F.col("text")), 256).alias("label"))


FOLDED_SQL = r"""
SELECT doc_id, sha256(CASE WHEN l = 'nan' THEN '' ELSE l END) AS label FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) l FROM documents)"""


def hilbert_places(spark, d) -> DataFrame:
    """Buildings along a Hilbert curve of 256 by 256 steps."""
    b = fixture(spark, d, "buildings")
    return b.select("building_id", g.hilbert_key(F.col("lon"), F.col("lat"), (-67.5, 17.9, -66.0, 18.5), 8).alias("place"))


def _hilbert_sql(bits: int) -> str:
    side = 1 << bits
    steps = [
        f"h{bits} AS (SELECT building_id, CAST(least(greatest(floor((lon - -67.5::DOUBLE) * {side / 1.5!r}::DOUBLE), 0), {side - 1}) AS BIGINT) x, CAST(least(greatest(floor((lat - 17.9::DOUBLE) * {side / (18.5 - 17.9)!r}::DOUBLE), 0), {side - 1}) AS BIGINT) y, 0::BIGINT d FROM {{buildings}})"
    ]
    for k in reversed(range(bits)):
        q = 1 << k
        steps.append(f"q{k} AS (SELECT *, CAST(x & {q} > 0 AS BIGINT) r, CAST(y & {q} > 0 AS BIGINT) u FROM h{k + 1})")
        turned = lambda c: f"CASE WHEN r = 1 THEN {side - 1} - {c} ELSE {c} END"
        steps.append(f"h{k} AS (SELECT building_id, CASE WHEN u = 0 THEN {turned('y')} ELSE x END x, CASE WHEN u = 0 THEN {turned('x')} ELSE y END y, d + {q * q} * xor(3 * r, u) d FROM q{k})")
    return "WITH " + ",\n".join(steps) + "\nSELECT building_id, d place FROM h0"


HILBERT_SQL = _hilbert_sql(8)


def merged_items(spark, d) -> DataFrame:
    """Orders as items, of which a later frame of customers replaces some."""
    o, c = fixture(spark, d, "orders"), fixture(spark, d, "customer")
    first = o.select((F.col("o_custkey") % 500).cast("string").alias("id"), F.concat(F.lit(" "), "o_orderstatus").alias("collection"), F.col("o_orderdate").cast("string").alias("datetime"), F.col("o_orderkey").alias("key"))
    later = c.select(F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey").cast("string")).alias("id"), F.lit("O").alias("collection"), F.lit(None).cast("string").alias("datetime"), (-F.col("c_custkey")).alias("key")).where("key % 3 = 0")
    return catalog.merged_items([first, later], order=[F.desc("key")]).select("id", F.trim("collection").alias("collection"), "key")


MERGED_SQL = """
WITH f AS (SELECT CAST(o_custkey % 500 AS VARCHAR) id, o_orderstatus collection, o_orderkey AS key, 0 n FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'O', -c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id, collection ORDER BY n DESC, key DESC) k FROM f)
SELECT id, collection, key FROM r WHERE k = 1"""


def stream_budget(spark, d) -> DataFrame:
    """The ledger as a stream: calls of each group of tiles, in order of time, while those that count stay below a cap."""
    root = f"{shared_folder(spark)}/budget-{uuid.uuid4().hex}"
    stream = parquet_stream(spark, f"{d}/events.parquet").withColumn("second", F.date_trunc("second", F.col("ts").cast("timestamp")))
    cost = (F.col("event_type").isin("click", "view") & (F.col("event_id") % 2 > 0)).cast("double")
    kept = budget.budgeted(stream, key=(F.col("user_id") % 8).cast("string"), ts="second", entry_id="event_id", cost=cost, cap=25.0, late="0 seconds")
    return budget.append_to(kept, f"{root}/out", f"{root}/state").select("k", "id", "cost", "spent_before")


BUDGET_SQL = """
WITH e AS (SELECT CAST(user_id % 8 AS VARCHAR) k, event_id id, CAST(event_type IN ('click', 'view') AND event_id % 2 > 0 AS DOUBLE) AS cost, date_trunc('second', ts) t FROM events),
r AS (SELECT k, id, cost, coalesce(sum(cost) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE spent_before FROM e)
SELECT * FROM r WHERE spent_before < 25"""


def consolidated_catalog(spark, d) -> DataFrame:
    """Items of parts in the consolidated table's columns, those that meet a boundary."""
    n, k = F.col("p_size"), F.col("p_partkey")
    asset = lambda name, href, *roles: F.struct(name.alias("name"), href.alias("href"), F.lit("x").alias("title"), F.array(*map(F.lit, roles)).cast("array<string>").alias("roles"))
    prop = {"eo:gsd": (n / 100).cast("string"), "platform": F.when(k % 3 > 0, "uav").otherwise(" "), "constellation": F.lit("c"), "cloud_cover": F.when(k % 5 > 0, (k % 5).cast("string")).otherwise("none"), "datetime": F.when(k % 4 > 0, F.lit("2024-05-06T07:08:09Z"))}
    corner = [(k % 100).cast("double"), n.cast("double"), (k % 100 + 1).cast("double"), (n + 1).cast("double")]
    items = fixture(spark, d, "part").select(
        k.cast("string").alias("id"), F.lit("c1").alias("collection"), F.create_map(*(x for key, v in prop.items() for x in (F.lit(key), v))).alias("properties"), F.lit("http://h/self").alias("self_href"),
        F.when(k % 9 > 0, F.struct(*(c.alias(x) for x, c in zip(("xmin", "ymin", "xmax", "ymax"), corner)))).alias("bbox"), F.when(k % 9 == 0, g.box(*corner)).alias("geom"),
        F.array(asset(F.lit("thumb-1"), F.lit("t.png"), "overview"), asset(F.when(n % 2 == 0, "nir").otherwise("pan"), F.lit("v.tif")), asset(F.lit("preview"), F.when(n % 3 > 0, "p.png"), "overview")).alias("assets"),
    )
    out = catalog.consolidated_rows(items, "parts", g.box(*(F.lit(v) for v in (10.5, 5.5, 60.5, 40.5))))
    return out.withColumn("area", _r(g.area(F.col("geometry")), 3)).withColumn("acquired_at", F.col("acquired_at").cast("string")).drop("geometry")


CONSOLIDATED_SQL = """
SELECT 'parts' source, CAST(p_partkey AS VARCHAR) item_id, 'c1' collection_id, CASE WHEN p_partkey % 4 > 0 THEN '2024-05-06 07:08:09' END acquired_at, CASE WHEN p_partkey % 3 > 0 THEN 'uav' END platform, 'c' constellation, p_size / 100 gsd,
  CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS DOUBLE) END cloud_cover, 'http://h/self' self_href, 't.png' visual_asset_href, CASE WHEN p_size % 2 = 0 THEN 'v.tif' END analytic_asset_href, CASE WHEN p_size % 3 > 0 THEN 'p.png' END preview_asset_href,
  't.png' thumbnail_asset_href, 3 asset_count, CAST(p_partkey % 100 AS DOUBLE) bbox_minx, CAST(p_size AS DOUBLE) bbox_miny, CAST(p_partkey % 100 + 1 AS DOUBLE) bbox_maxx, CAST(p_size + 1 AS DOUBLE) bbox_maxy, 1.0::DOUBLE area
FROM part WHERE p_partkey % 100 <= 60.5 AND p_partkey % 100 + 1 >= 10.5 AND p_size <= 40.5 AND p_size + 1 >= 5.5"""


def survey_shares(spark, d) -> DataFrame:
    """A survey's coded columns by name, with identifiers, sums and shares."""
    acs = fixture(spark, d, "acs").select(F.substring("bg_geoid", 1, 2).alias("state"), F.substring("bg_geoid", 3, 3).alias("county"), F.substring("bg_geoid", 6, 6).alias("tract"), F.substring("bg_geoid", 12, 1).alias("block"), F.col("g1").alias("B1_001"), F.col("g2").alias("B1_002"), F.col("g3").alias("B1_003"), F.col("total").alias("B1_000"), F.col("owners").alias("B2_001"), F.col("households").alias("B2_000"), F.col("bg_geoid").alias("NAME"))
    out = census.survey_frame(
        acs, level="block group", names={"B1_000": "people", "B1_001": "g1", "B1_002": "g2", "B1_003": "g3", "B2_000": "homes", "B2_001": "owners", "B9_999": "nowhere"}, parts={"state": 2, "county": 3, "tract": 6, "block": 1}, geoid_column="geoid",
        sums={"first_two": ["g1", "g2"], "none": ["nowhere"]}, shares={"owner_share": (["owners"], "homes"), "some_share": (["g1", "g3"], "people"), "g1_share": (["g1"], "people"), "two_share": (["first_two"], "people"), "no_share": (["g1"], "nowhere")}, groups=["g1", "g2", "g3"], total="people",
    )
    return out.select("geography_level", "geoid", "people", "first_two", "none", *(_r(c).alias(c) for c in ("diversity_index", "owner_share", "some_share", "g1_share", "two_share", "no_share")))


SURVEY_SQL = """
WITH n AS (SELECT bg_geoid geoid, CASE WHEN try_cast(g1 AS DOUBLE) > -100000000 THEN try_cast(g1 AS DOUBLE) END g1, CAST(g2 AS DOUBLE) g2, CAST(g3 AS DOUBLE) g3, CAST(total AS DOUBLE) people, CAST(owners AS DOUBLE) o, CAST(households AS DOUBLE) h FROM {acs})
SELECT 'block group' geography_level, geoid, people, coalesce(g1, 0) + g2 first_two, NULL::DOUBLE AS none, round(1 - (g1 / nullif(people, 0)) ** 2 - (g2 / nullif(people, 0)) ** 2 - (g3 / nullif(people, 0)) ** 2, 6) diversity_index, round(o / nullif(h, 0), 6) owner_share,
  round((coalesce(g1, 0) + g3) / nullif(people, 0), 6) some_share, round(g1 / nullif(people, 0), 6) g1_share, round((coalesce(g1, 0) + g2) / nullif(people, 0), 6) two_share, NULL::DOUBLE no_share FROM n"""


def pv_sources(spark, d) -> DataFrame:
    """Panels per county from the clean table, from raw shapes with tags, and from the counties' own flag."""
    c = with_box(fixture(spark, d, "counties")).withColumn("has_pv", F.col("county") % 3 == 0)
    p = with_box(fixture(spark, d, "panels"))
    raw = p.withColumns({"generator:source": F.when(F.col("size") % 2 == 0, "SOLAR"), "content": F.when(F.col("size") % 10 == 0, "hot_water")})
    options = {"area_id": "geoid", "name": "name", "cell": 0.02}
    clean = panels_of(p, c)
    parts = [rooftops.pv_counts(c, clean=clean, stage=raw, **options), rooftops.pv_counts(c, stage=raw, **options), rooftops.pv_counts(c, **options)]
    out = None
    for df, source in parts:
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df)
    return out


def panels_of(panels: DataFrame, areas: DataFrame) -> DataFrame:
    """Panels with the area that holds their centre."""
    dots = panels.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2})
    return points_within(dots, areas, point_id="panel_id", area_id="geoid", x="x", y="y", cell=0.02, boxes=True).join(areas.select("geoid", "name"), "geoid")


SOURCES_SQL = """
WITH c AS (SELECT * FROM {counties}), p AS (SELECT * FROM {panels})
SELECT geoid, name, count(*) panels, 'clean' source FROM c JOIN p ON (p.minx + p.maxx) / 2 >= c.minx AND (p.minx + p.maxx) / 2 < c.maxx AND (p.miny + p.maxy) / 2 >= c.miny AND (p.miny + p.maxy) / 2 < c.maxy GROUP BY 1, 2
UNION ALL SELECT geoid, name, count(p.panel_id), 'stage' FROM c LEFT JOIN p ON p.minx <= c.maxx AND c.minx <= p.maxx AND p.miny <= c.maxy AND c.miny <= p.maxy AND p.size % 2 = 0 AND p.size % 10 <> 0 GROUP BY 1, 2
UNION ALL SELECT geoid, name, CAST(county % 3 = 0 AS BIGINT), 'flag' FROM c"""


def asset_groups(spark, d) -> DataFrame:
    """Line items of the first fifty groups of supplier and ship mode, in order of price; and a summary of all groups."""
    li = fixture(spark, d, "lineitem").withColumn("part", F.col("l_suppkey") % 40)
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    kept = tables.first_groups(li, ["part", "l_returnflag"], order, 50)
    return kept.groupBy("part", "l_returnflag").agg(F.count("*").alias("n"), F.max("l_extendedprice").cast("double").alias("most"))


GROUPS_SQL = """
WITH l AS (SELECT *, l_suppkey % 40 part FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY part, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) k FROM l),
t AS (SELECT part, l_returnflag FROM f WHERE k = 1 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, part, l_returnflag LIMIT 50)
SELECT part, l_returnflag, count(*) n, CAST(max(l_extendedprice) AS DOUBLE) most FROM l JOIN t USING (part, l_returnflag) GROUP BY 1, 2"""

def morans_permuted(spark, d) -> DataFrame:
    """Moran's I of population per county with 999 permutations: pseudo p and z."""
    bg = with_box(fixture(spark, d, "block_groups"))
    values = bg.join(fixture(spark, d, "acs").select(F.col("bg_geoid").alias("geoid"), "population"), "geoid")
    out = statistics.morans_i(values, contiguity(bg, area_id="geoid"), area_id="geoid", value="population", by="county_geoid", permutations=999)
    return out.select("county_geoid", "n", _r("moran_i").alias("moran_i"), _r("pseudo_p", 4).alias("pseudo_p"), _r("z", 4).alias("z"))


PERMUTED_SQL = """
WITH v AS (SELECT g.county_geoid c, g.geoid, minx, maxx, miny, a.population - avg(a.population) OVER (PARTITION BY county_geoid) z, count(*) OVER (PARTITION BY county_geoid) n, row_number() OVER (PARTITION BY county_geoid ORDER BY g.geoid) p
  FROM {block_groups} g JOIN {acs} a ON a.bg_geoid = g.geoid),
e AS (SELECT a.c, a.p s, b.p t, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.geoid) w FROM v a JOIN v b ON a.c = b.c AND a.geoid <> b.geoid AND abs(a.minx - b.minx) < 1.05 * (a.maxx - a.minx) AND abs(a.miny - b.miny) < 0.035),
d AS (SELECT c, k, z, n, row_number() OVER (PARTITION BY c, k ORDER BY CASE WHEN k = 0 THEN '' ELSE md5('1-' || k || '-' || geoid) END, geoid) p FROM v, (SELECT unnest(range(1000)) k) WHERE n >= 5),
i AS (SELECT e.c, a.k, sum(w * a.z * b.z) / sum(w) m FROM e JOIN d a ON a.c = e.c AND a.p = e.s JOIN d b ON b.c = e.c AND b.p = e.t AND b.k = a.k GROUP BY 1, 2),
j AS (SELECT i.c, k, m * q.n / q.zz i, q.n FROM i JOIN (SELECT c, count(*) n, sum(z * z) zz FROM v GROUP BY 1) q ON q.c = i.c),
o AS (SELECT c, n, i FROM j WHERE k = 0)
SELECT o.c county_geoid, o.n, round(o.i, 6) moran_i, round((least(count(*) FILTER (j.i >= o.i), 999 - count(*) FILTER (j.i >= o.i)) + 1) / 1000::DOUBLE, 4) pseudo_p, round((o.i - avg(j.i)) / stddev_pop(j.i), 4) z
FROM o JOIN j ON j.c = o.c AND k > 0 GROUP BY o.c, o.n, o.i"""


def panels_by_area(spark, d) -> DataFrame:
    """Panels by the county that holds their centre, else one they meet: number, projected area, its mean, and the largest panel."""
    p = with_box(fixture(spark, d, "panels"))
    p = p.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2 + 0.04, "y": (F.col("miny") + F.col("maxy")) / 2})
    own = assign_any(p.withColumns({"maxx": F.col("maxx") + 0.04}), with_box(fixture(spark, d, "counties")), left_id="panel_id", area_id="geoid", x="x", y="y", cell=0.02, boxes=True)
    out = areas_of(own.where("geoid IS NOT NULL"), ["geoid"], to=g.to_mercator, id_column="panel_id")
    return out.select("geoid", "shapes", _r("area", 2).alias("area"), _r("mean_area", 3).alias("mean_area"))


_MERC_X, _MERC_Y = "6378137 * radians({0})", "6378137 * ln(tan(pi() / 4 + radians({0}) / 2))"
AREAS_SQL = f"""
WITH p AS (SELECT panel_id, minx, maxx, miny, maxy, maxx + 0.04::DOUBLE mx, (minx + maxx) / 2 + 0.04::DOUBLE x, (miny + maxy) / 2 y FROM {{panels}}), c AS (SELECT * FROM {{counties}}),
i AS (SELECT panel_id, min(geoid) geoid FROM p JOIN c ON x >= c.minx AND x < c.maxx AND y >= c.miny AND y < c.maxy GROUP BY 1),
m AS (SELECT panel_id, min(geoid) geoid FROM p JOIN c ON p.minx <= c.maxx AND c.minx <= p.mx AND p.miny <= c.maxy AND c.miny <= p.maxy GROUP BY 1),
a AS (SELECT coalesce(i.geoid, m.geoid) geoid, ({_MERC_X.format("p.maxx")} - {_MERC_X.format("p.minx")}) * ({_MERC_Y.format("p.maxy")} - {_MERC_Y.format("p.miny")}) size FROM p LEFT JOIN i ON i.panel_id = p.panel_id LEFT JOIN m ON m.panel_id = p.panel_id)
SELECT geoid, count(*) shapes, round(sum(size), 2) area, round(avg(size), 3) mean_area FROM a WHERE geoid IS NOT NULL GROUP BY 1"""

_ALL = {
    "newest_items": (newest_items, NEWEST_SQL),
    "canonical_nested": (canonical_nested, NESTED_SQL),
    "folded_labels": (folded_labels, FOLDED_SQL),
    "hilbert_places": (hilbert_places, HILBERT_SQL),
    "merged_items": (merged_items, MERGED_SQL),
    "stream_budget": (stream_budget, BUDGET_SQL),
    "consolidated_catalog": (consolidated_catalog, CONSOLIDATED_SQL),
    "survey_shares": (survey_shares, SURVEY_SQL),
    "pv_sources": (pv_sources, SOURCES_SQL),
    "asset_groups": (asset_groups, GROUPS_SQL),
    "morans_permuted": (morans_permuted, PERMUTED_SQL),
    "panels_by_area": (panels_by_area, AREAS_SQL),
}

QUERIES = {n: f for n, (f, _) in _ALL.items()}
ORACLE_SQL = {n: expanded(sql) if n not in ("canonical_nested",) else sql for n, (_, sql) in _ALL.items()}
