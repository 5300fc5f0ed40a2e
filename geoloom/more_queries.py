"""Further queries over the geography tables: flags, choices, probes, detections, catalogs; each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import expanded, fixture
from .functions import geometry as g
from .functions import scalars as s
from .operators import spatial, tables
from .plans import catalog, manifest, rooftops
from .sources.files import shared_folder, spread

SMALL = 2e-4
_MEET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
_OVER = "greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0)"


def pv_flags(spark, d) -> DataFrame:
    """Per class: buildings with mapped and with detected panels, both, areas, and a pixel-weighted mean."""
    b, p = fixture(spark, d, "buildings"), fixture(spark, d, "panels")
    pairs = lambda odd: spatial.overlap_pairs(b, p.where(F.col("size") % 2 == odd), left_id="building_id", right_id="panel_id", cell=SMALL, boxes=True)
    flags = rooftops.pv_flags(b, pairs(0), pairs(1))
    flags = flags.withColumns({"flux": F.when(F.col("building_id") % 5 > 0, F.col("height").cast("double")), "pixels": F.col("building_id") % 7})
    out = rooftops.flag_summary(flags, ["class"], "flux", "pixels")
    return out.withColumns({"area": F.round(F.col("area") * 1e9, 3), "rate": F.round("rate", 6), "flux_mean": F.round("flux_mean", 6)})


FLAG_SQL = f"""
WITH a AS (SELECT * FROM {{buildings}}), p AS (SELECT * FROM {{panels}}),
m AS (SELECT DISTINCT building_id FROM a JOIN p b ON {_MEET} AND size % 2 = 0),
t AS (SELECT building_id, count(*) n, sum({_OVER}) o FROM a JOIN p b ON {_MEET} AND size % 2 = 1 GROUP BY 1),
f AS (SELECT a.*, m.building_id IS NOT NULL x, t.n IS NOT NULL y, coalesce(o, 0) o, CASE WHEN a.building_id % 5 > 0 THEN CAST(height AS DOUBLE) END v, a.building_id % 7 w FROM a LEFT JOIN m ON m.building_id = a.building_id LEFT JOIN t ON t.building_id = a.building_id)
SELECT class, count(*) buildings, count(*) FILTER (x) mapped, count(*) FILTER (y) detected, count(*) FILTER (x AND y) AS both, round(sum(o) * 1e9, 3) area,
  round(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) flux_mean, CAST(sum(w) AS BIGINT) flux_pixels, round(count(*) FILTER (y) / count(*), 6) rate FROM f GROUP BY 1"""


def detection_filter(spark, d) -> DataFrame:
    """Detections by type that pass the area and elongation filter."""
    p = fixture(spark, d, "part").withColumns({"area": F.col("p_retailprice").cast("double") / 5, "short": F.col("p_partkey") % 7})
    return rooftops.detections_kept(p, "area", "p_size", "short").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


DETECTION_SQL = """
SELECT p_type, count(*) n, CAST(sum(p_partkey) AS BIGINT) keys FROM part
WHERE CAST(p_retailprice AS DOUBLE) / 5 BETWEEN 3 AND 500 AND p_size / nullif(p_partkey % 7, 0) < 10 GROUP BY 1"""


def raster_cascade(spark, d) -> DataFrame:
    """Rasters by the filters whose columns exist, the first filled path, one row per path."""
    p = fixture(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("/a/"), (F.col("p_partkey") % 700).cast("string"))).alias("path"), F.concat(F.lit("/b/"), (F.col("p_partkey") % 500).cast("string")).alias("copy"),
        F.when(F.col("p_size") % 2 == 0, "RGB").when(F.col("p_size") % 3 == 0, "visual").otherwise("mask").alias("layer"), (F.col("p_size") % 5 > 0).alias("training_eligible"),
    )
    return rooftops.cascaded(p, municipio="x", paths=["path", "copy"]).select("p_partkey", "layer", "found_path")


CASCADE_SQL = """
WITH r AS (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN '/a/' || (p_partkey % 700) END, '/b/' || (p_partkey % 500)) found_path, CASE WHEN p_size % 2 = 0 THEN 'RGB' WHEN p_size % 3 = 0 THEN 'visual' ELSE 'mask' END layer FROM part WHERE p_size % 5 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY found_path ORDER BY p_partkey) n FROM r WHERE layer <> 'mask')
SELECT p_partkey, layer, found_path FROM k WHERE n = 1"""


def training_cells(spark, d) -> DataFrame:
    """Cells for training, capped per group and in all."""
    c = fixture(spark, d, "customer").select(F.col("c_custkey").alias("tile_id"), F.col("c_mktsegment").alias("municipio"), (F.col("c_custkey") % 4).alias("priority"), F.col("c_nationkey").alias("panels"), (F.col("c_custkey") % 13).alias("building_count"))
    return rooftops.training_cells(c, municipios=["BUILDING", "MACHINERY", "FURNITURE"], least_priority=2, per_group=40, most=100)


CELL_SQL = """
WITH c AS (SELECT c_custkey tile_id, c_mktsegment municipio, c_custkey % 4 priority, c_nationkey panels, c_custkey % 13 building_count FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY municipio ORDER BY priority DESC, panels DESC, building_count DESC, tile_id) n FROM c WHERE municipio IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND panels > 0 AND priority >= 2)
SELECT * EXCLUDE (n) FROM r WHERE n <= 40 ORDER BY priority DESC, panels DESC, building_count DESC, tile_id LIMIT 100"""


def _probe(spark, d) -> DataFrame:
    e = F.col("event_id")
    quality = lambda k: F.when(k == 0, "HIGH").when(k == 1, "MEDIUM").when(k == 2, "BASE")
    return fixture(spark, d, "ledger").select(
        "tile_id", "status", quality(e % 4).alias("quality"), F.when(e % 6 > 0, F.to_date("ts")).alias("imagery_date"), quality(e % 3).alias("requested_quality"), (e % 5).alias("priority_score"), "event_id", (e % 3 * 100).alias("http_status")
    )


_QUALITY = "CASE event_id % {0} WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'BASE' END"
_PROBE = f"p AS (SELECT tile_id, status, {_QUALITY.format(4)} quality, CASE WHEN event_id % 6 > 0 THEN CAST(ts AS DATE) END d, {_QUALITY.format(3)} requested, event_id % 5 score, event_id, event_id % 3 * 100 http_status FROM {{ledger}})"
_RANK = "CASE {0} WHEN 'MEDIUM' THEN 2 WHEN 'BASE' THEN 1 ELSE 0 END"


def fetch_order(spark, d) -> DataFrame:
    """The probe that is fetched, per tile."""
    out = manifest.fetch_candidates(_probe(spark, d), CUTOFF, ["MEDIUM", "BASE"])
    return out.select("tile_id", "event_id", "fetch_quality", F.col("imagery_date").cast("string").alias("day"))


CUTOFF = "2024-01-10"
FETCH_SQL = f"""
WITH {_PROBE}, r AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY d DESC, {_RANK.format("quality")} DESC, {_RANK.format("requested")} DESC, score DESC, quality, requested, event_id) n FROM p WHERE status = 'ok' AND quality IN ('MEDIUM', 'BASE') AND d >= DATE '{CUTOFF}')
SELECT tile_id, event_id, quality fetch_quality, CAST(d AS VARCHAR) AS day FROM r WHERE n = 1"""


def probe_report(spark, d) -> DataFrame:
    """Probes: verdicts of tiles, counts by status, quality and period, failures; as one table."""
    probe = _probe(spark, d)
    verdicts = manifest.probe_verdict(manifest.collapsed_probe(probe), CUTOFF).groupBy(F.col("manifest_status").alias("key")).agg(F.count("*").alias("tiles"))
    tiles, failed = manifest.probe_summary(probe, CUTOFF, [])
    text = lambda *c: F.concat_ws("/", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c)).alias("key")
    part = lambda name, df: df.select(F.lit(name).alias("part"), "key", "tiles")
    return part("verdict", verdicts).union(part("period", tiles.select(text("status", "quality", "period"), "tiles"))).union(part("failed", failed.select(text("status", "http_status"), "tiles")))


REPORT_SQL = f"""
WITH {_PROBE}, k AS (SELECT *, CASE quality WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'BASE' THEN 3 ELSE 4 END q FROM p),
o AS (SELECT tile_id, first(status ORDER BY q, d DESC NULLS LAST, status) FILTER (status IS NOT NULL) status, first(d ORDER BY q, d DESC NULLS LAST, status) FILTER (d IS NOT NULL) d FROM k GROUP BY 1)
SELECT 'verdict' part, CASE WHEN status = 'ok' AND coalesce(d >= DATE '{CUTOFF}', false) THEN 'ready' WHEN status = 'ok' THEN 'stale' WHEN status = 'not_found' THEN 'no_coverage' ELSE 'probe_failed' END AS key, count(*) tiles FROM o GROUP BY 2
UNION ALL SELECT 'period', coalesce(status, '-') || '/' || coalesce(quality, '-') || '/' || coalesce(CASE WHEN d >= DATE '{CUTOFF}' THEN 'after' WHEN d IS NOT NULL THEN 'before' END, '-'), count(*) FROM p GROUP BY 2
UNION ALL SELECT 'failed', coalesce(status, '-') || '/' || http_status, count(*) FROM p WHERE coalesce(status <> 'ok', true) GROUP BY 2"""


def cutoff_counts(spark, d) -> DataFrame:
    """Events before and after a cutoff, and how complete the ledger is, per type."""
    e = fixture(spark, d, "events").withColumn("seen", F.when(F.col("event_id") % 11 > 0, F.col("ts").cast("timestamp")))
    counts = rooftops.cutoff_counts(e, "seen", CUTOFF, ["event_type"])
    full = rooftops.completeness(e, ["seen", "user_id"], ["event_type"])
    return counts.join(full, "event_type").withColumns({c: F.to_date(c).cast("string") for c in ("earliest", "latest")})


CUTOFF_SQL = f"""
WITH e AS (SELECT *, CASE WHEN event_id % 11 > 0 THEN ts END seen FROM events)
SELECT event_type, count(*) FILTER (seen < TIMESTAMP '{CUTOFF}') AS before, count(*) FILTER (seen >= TIMESTAMP '{CUTOFF}') AS after, count(*) FILTER (seen IS NULL) AS none, CAST(CAST(min(seen) AS DATE) AS VARCHAR) earliest, CAST(CAST(max(seen) AS DATE) AS VARCHAR) latest,
  count(*) AS rows, count(seen) with_seen, count(user_id) with_user_id FROM e GROUP BY 1"""


def candidate_buildings(spark, d) -> DataFrame:
    """Buildings with panels in the classes that have most, with the number of panels and overlap."""
    b, p = fixture(spark, d, "buildings"), fixture(spark, d, "panels")
    out = rooftops.candidate_buildings(b, p, cell=SMALL, overlap=g.bbox_overlap_area("l", "r"), area="class", top=2)
    return out.withColumn("overlap", F.round(F.col("overlap") * 1e9, 3))


CANDIDATE_SQL = f"""
WITH a AS (SELECT * FROM {{buildings}}), b AS (SELECT * FROM {{panels}}), p AS (SELECT building_id, class, panel_id, {_OVER} o FROM a JOIN b ON {_MEET}),
t AS (SELECT class FROM p GROUP BY 1 ORDER BY count(DISTINCT panel_id) DESC, class LIMIT 2)
SELECT building_id, class, count(DISTINCT panel_id) panels, round(sum(o) * 1e9, 3) overlap FROM p JOIN t USING (class) GROUP BY ALL"""


def disk_points(spark, d) -> DataFrame:
    """Panels in tiles' disks, which overlap: per tile, and those in no other."""
    b, p = fixture(spark, d, "buildings"), fixture(spark, d, "panels")
    tiles = b.where(F.col("building_id") % 40 == 0).select(F.col("building_id").alias("tile"), F.col("lon").alias("x"), F.col("lat").alias("y"), (F.lit(0.004) + (F.col("building_id") % 3) * 0.004).alias("radius"))
    dots = p.select("panel_id", F.col("minx").alias("px"), F.col("miny").alias("py"))
    found = rooftops.points_in_disks(tiles, dots, tile_id="tile", point_id="panel_id", x="px", y="py", cell=0.004)
    return found.groupBy("tile").agg(F.countDistinct("panel_id").alias("panels"), F.sum("panel_id").alias("keys"))


DISK_SQL = """
WITH t AS (SELECT building_id tile, lon x, lat y, 0.004::DOUBLE + (building_id % 3) * 0.004::DOUBLE r FROM {buildings} WHERE building_id % 40 = 0), p AS (SELECT * FROM {panels})
SELECT tile, count(DISTINCT panel_id) panels, CAST(sum(panel_id) AS BIGINT) keys FROM t JOIN p ON (minx - x) * (minx - x) + (miny - y) * (miny - y) <= r * r GROUP BY 1"""


def covered_candidates(spark, d) -> DataFrame:
    """Buildings that meet at least one preferred footprint, per class."""
    b = fixture(spark, d, "buildings")
    prints = b.where(F.col("building_id") % 30 == 0).select(*((F.col(c) + k).alias(c) for c, k in (("minx", -0.003), ("miny", -0.002), ("maxx", 0.003), ("maxy", 0.002))))
    return rooftops.meeting_any(b, prints, key="building_id", cell=SMALL).groupBy("class").agg(F.count("*").alias("n"), F.sum("building_id").alias("keys"))


COVERED_SQL = f"""
WITH a AS (SELECT * FROM {{buildings}}), b AS (SELECT minx - 0.003::DOUBLE minx, miny - 0.002::DOUBLE miny, maxx + 0.003::DOUBLE maxx, maxy + 0.002::DOUBLE maxy FROM a WHERE building_id % 30 = 0)
SELECT class, count(*) n, CAST(sum(building_id) AS BIGINT) keys FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_MEET}) GROUP BY 1"""


def part_summary(spark, d) -> DataFrame:
    """Parts by brand: counts, total, mean and largest size."""
    p = fixture(spark, d, "part")
    out = rooftops.feature_summary(p, ["p_brand"], F.when(F.col("p_size") % 9 > 0, F.col("p_size").cast("double")), "p_partkey")
    return out.withColumn("mean_area", F.round("mean_area", 6))


SUMMARY_SQL = """
WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 9 > 0 THEN CAST(p_size AS DOUBLE) END a FROM part)
SELECT p_brand, count(*) n, count(DISTINCT p_partkey) keys, sum(a) area, round(avg(a), 6) mean_area, first(p_partkey ORDER BY a DESC, p_partkey) FILTER (a IS NOT NULL) largest FROM p GROUP BY 1"""


def top_rows(spark, d) -> DataFrame:
    """Top k, anomalies, a named choice and the rows of least rank per group, as one table."""
    c, p = fixture(spark, d, "customer"), fixture(spark, d, "part")
    top = rooftops.ranked_counts(p, "p_type", 7).select(F.lit("top").alias("part"), F.col("p_type").alias("key"), F.col("n").cast("long").alias("n"))
    odd = rooftops.above(c.withColumn("ratio", F.col("c_acctbal").cast("double") / 5000), "ratio", 1.0, "c_custkey", 9).select(F.lit("above"), F.col("c_custkey").cast("string"), F.lit(1).cast("long"))
    one = rooftops.chosen(rooftops.ranked_counts(c, "c_mktsegment", 9), "c_mktsegment", [F.col("rank")], " machinery ").select(F.lit("chosen"), F.col("c_mktsegment"), F.col("n"))
    rank = rooftops.least_known(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal").cast("double")), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey").cast("double")))
    least = tables.first_per(c.withColumn("rank", rank), ["c_mktsegment"], [F.desc("rank"), F.col("c_custkey")], 10).select(F.lit("least"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("long"))
    return top.union(odd).union(one).union(least)


TOP_SQL = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(least(CASE WHEN c_custkey % 3 > 0 THEN CAST(c_acctbal AS DOUBLE) END, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_nationkey AS DOUBLE) END), -1) DESC, c_custkey) k FROM customer)
SELECT * FROM (SELECT 'top' part, p_type AS key, count(*) n FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 7)
UNION ALL SELECT * FROM (SELECT 'above', CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE CAST(c_acctbal AS DOUBLE) / 5000 > 1 ORDER BY CAST(c_acctbal AS DOUBLE) / 5000 DESC, c_custkey LIMIT 9)
UNION ALL SELECT 'chosen', 'MACHINERY', count(*) FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'least', CAST(c_custkey AS VARCHAR), c_nationkey FROM l WHERE k <= 10"""


def canonical_items(spark, d) -> DataFrame:
    """Parts as JSON with sorted keys, and coercions of text to lists and numbers."""
    p = fixture(spark, d, "part")
    item = s.canonical_json({"size": F.col("p_size"), "brand": F.col("p_brand"), "id": F.col("p_partkey"), "area": F.when(F.col("p_size") % 2 == 0, F.col("p_size"))})
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('["'), "p_brand", F.lit('","x"]'))).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(F.lit(" "))
    return p.select("p_partkey", item.alias("item"), F.array_join(s.coerced_list(text), "|").alias("list"), s.whole_number(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ".5").otherwise(".0"))).alias("whole"))


CANONICAL_SQL = """
SELECT p_partkey, '{"area":' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || ',"brand":"' || p_brand || '","id":' || p_partkey || ',"size":' || p_size || '}' item,
  CASE p_size % 3 WHEN 0 THEN p_brand || '|x' WHEN 1 THEN p_brand ELSE '' END list, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS BIGINT) END whole FROM part"""


def picked_assets(spark, d) -> DataFrame:
    """The asset that each item offers, by name, role or keyword."""
    n = F.col("p_size")
    asset = lambda name, href, title, *roles: F.struct(name.alias("name"), href.alias("href"), title.alias("title"), F.array(*map(F.lit, roles)).alias("roles"))
    assets = F.array(
        asset(F.lit("Preview"), F.lit("p.png"), F.lit("data"), "data"),
        asset(F.when(n % 5 == 0, "visual").otherwise("Visual"), F.when(n % 10 > 0, "v.tif"), F.lit("x"), "other"),
        asset(F.lit("b1"), F.when(n % 4 > 0, "b1.jp2").otherwise(" "), F.lit("Overview"), "Overview"),
        asset(F.lit("b2"), F.concat(F.lit("b2."), F.when(n % 3 == 0, "TIF").otherwise("png")), F.lit(None).cast("string"), "data"),
    )
    pick = catalog.picked_asset(assets, ["visual"], ["overview"], ["tif"], ["preview"])
    return fixture(spark, d, "part").select("p_partkey", pick["name"].alias("name"), pick["href"].alias("href"))


ASSET_SQL = """
WITH p AS (SELECT p_partkey, p_size n FROM part),
q AS (SELECT *, CASE WHEN n % 5 = 0 AND n % 10 > 0 THEN 1 WHEN n % 4 > 0 THEN 2 WHEN n % 10 > 0 THEN 3 WHEN n % 3 = 0 THEN 4 ELSE 0 END k FROM p)
SELECT p_partkey, CASE k WHEN 1 THEN 'visual' WHEN 2 THEN 'b1' WHEN 3 THEN 'Visual' WHEN 4 THEN 'b2' END AS name, CASE k WHEN 1 THEN 'v.tif' WHEN 2 THEN 'b1.jp2' WHEN 3 THEN 'v.tif' WHEN 4 THEN 'b2.TIF' END href FROM q"""


def catalog_walk(spark, d) -> DataFrame:
    """Documents linked as a tree with cycles, walked from its root, some pruned; counts by level and kind."""
    p = spread(fixture(spark, d, "part").select(F.col("p_partkey").alias("k")))
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"))
    at = lambda e: e.cast("string")
    k = F.col("k")
    links = F.array(
        link("child", F.concat(F.lit("../../d/"), at(2 * k), F.lit("/c.json"))), link("child", F.concat(F.lit("./.././"), at(2 * k + 1), F.lit("/c.json"))), link("child", F.lit("../1/c.json")),
        link("item", F.concat(F.lit("/a/i/"), at(k), F.lit(".json"))), link("self", F.lit("c.json")),
    )
    docs = p.select(F.concat(F.lit("http://h.org/a/d/"), at(k), F.lit("/c.json")).alias("url"), links.alias("links"), k)
    items = p.select(F.concat(F.lit("http://h.org/a/i/"), at(k), F.lit(".json")).alias("url"), F.array(link("child", F.lit("../d/1/c.json"))).alias("links"), k)
    folder, n = shared_folder(spark), iter(range(1 << 30))
    run = f"{folder}/walk-{uuid.uuid4().hex}"

    def save(df: DataFrame) -> DataFrame:
        path = f"{run}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    roots = spark.createDataFrame([("http://h.org/a/d/1/c.json",)], "url string")
    found = catalog.traversed(docs.unionByName(items), roots, save, prune=F.col("k") % 7 != 0, keep_item=F.col("k") % 3 == 0)
    return found.groupBy("level", "kind").agg(F.count("*").alias("n"))


WALK_SQL = """
WITH RECURSIVE w AS (
  SELECT p_partkey k, 0 AS level FROM part WHERE p_partkey = 1
  UNION ALL SELECT p.p_partkey, level + 1 FROM w JOIN part p ON (p.p_partkey = 2 * k OR p.p_partkey = 2 * k + 1) AND p.p_partkey > 1 WHERE k % 7 <> 0)
SELECT level, 'catalog' kind, count(*) n FROM w GROUP BY 1
UNION ALL SELECT level + 1, 'item', count(*) FROM w WHERE k % 7 <> 0 AND k % 3 = 0 GROUP BY 1"""

def catalog_rows(spark, d) -> DataFrame:
    """Items in the catalog's columns."""
    n, k = F.col("p_size"), F.col("p_partkey")
    asset = lambda name, href, *roles: F.struct(name.alias("name"), href.alias("href"), F.lit("x").alias("title"), F.array(*map(F.lit, roles)).alias("roles"))
    prop = {"gsd": (n / 100).cast("string"), "proj:code": F.when(k % 2 == 0, "EPSG:3857"), "proj:epsg": F.when(k % 2 == 1, "26920"), "license": F.when(k % 3 > 0, "CC").otherwise(" "), "cloud_cover": F.when(k % 5 > 0, (k % 5).cast("string")).otherwise("none")}
    items = fixture(spark, d, "part").select(
        k.cast("string").alias("id"), F.lit("c1").alias("collection"), F.create_map(*(x for key, v in prop.items() for x in (F.lit(key), v))).alias("properties"), F.array(*(n.cast("double") + i for i in range(4))).alias("bbox"),
        F.array(
            asset(F.lit("thumb-1"), F.lit("t.png"), "overview"), asset(F.when(n % 2 == 0, "visual").otherwise("pan"), F.when(n % 7 > 0, "v.png"), "other"), asset(F.lit("nir"), F.lit("n.png"), "Data"),
            asset(F.lit("preview"), F.when(n % 3 > 0, "p.png"), "overview"),
        ).alias("assets"),
    )
    out = catalog.catalog_rows(items, "parts", "static")
    return out.select("item_id", "collection_id", "gsd", "proj_epsg", "license", "cloud_cover", "item_type", "primary_asset_name", "visual_asset_name", "analytic_asset_href", "preview_asset_name", "thumbnail_asset_name", "asset_count", "available_asset_names", "bbox_minx", "bbox_maxy")


ROWS_SQL = """
SELECT CAST(p_partkey AS VARCHAR) item_id, 'c1' collection_id, p_size / 100 gsd, CASE WHEN p_partkey % 2 = 0 THEN 3857 ELSE 26920 END proj_epsg, CASE WHEN p_partkey % 3 > 0 THEN 'CC' END license, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS DOUBLE) END cloud_cover, 'Feature' item_type,
  'nir' primary_asset_name, CASE WHEN p_size % 2 = 0 AND p_size % 7 > 0 THEN 'visual' ELSE 'nir' END visual_asset_name, 'n.png' analytic_asset_href, CASE WHEN p_size % 3 > 0 THEN 'preview' END preview_asset_name, 'thumb-1' thumbnail_asset_name, 4 asset_count,
  CASE WHEN p_size % 2 = 0 THEN '["nir","preview","thumb-1","visual"]' ELSE '["nir","pan","preview","thumb-1"]' END available_asset_names, CAST(p_size AS DOUBLE) bbox_minx, CAST(p_size + 3 AS DOUBLE) bbox_maxy FROM part"""

_ALL = {
    "catalog_rows": (catalog_rows, ROWS_SQL),
    "pv_flags": (pv_flags, FLAG_SQL),
    "detection_filter": (detection_filter, DETECTION_SQL),
    "raster_cascade": (raster_cascade, CASCADE_SQL),
    "training_cells": (training_cells, CELL_SQL),
    "fetch_order": (fetch_order, FETCH_SQL),
    "probe_report": (probe_report, REPORT_SQL),
    "cutoff_counts": (cutoff_counts, CUTOFF_SQL),
    "candidate_buildings": (candidate_buildings, CANDIDATE_SQL),
    "disk_points": (disk_points, DISK_SQL),
    "covered_candidates": (covered_candidates, COVERED_SQL),
    "part_summary": (part_summary, SUMMARY_SQL),
    "top_rows": (top_rows, TOP_SQL),
    "canonical_items": (canonical_items, CANONICAL_SQL),
    "picked_assets": (picked_assets, ASSET_SQL),
    "catalog_walk": (catalog_walk, WALK_SQL),
}

QUERIES = {n: f for n, (f, _) in _ALL.items()}
ORACLE_SQL = {n: expanded(sql) if "{" in sql and n != "canonical_items" else sql for n, (_, sql) in _ALL.items()}
