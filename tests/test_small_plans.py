import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import spatial, statistics
from geoloom.operators import tables as t
from geoloom.plans import catalog, census, imagery, rooftops
from geoloom.sources import files

from .test_geometry import RING, rect


def test_picks_fall_back_to_the_first(spark):
    df = spark.range(20)
    ids = lambda *a, **k: sorted(r.id for r in t.picks_and_random(df, "id", *a, **k).collect())
    assert ids([99], None, 3, fallback=6) == [0, 1, 2, 3, 4, 5] and ids([7, 3], None, 3, fallback=6) == [3, 7] and len(ids([], "s", 4, fallback=6)) == 4
    assert ids([], "s", 0, fallback=2) == [0, 1] and t.picks_and_random(df.limit(0), "id", [1], "s", 2, fallback=6).isEmpty()


def test_first_groups(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2), (None, 3), (None, 9), ("c", 4)], "k string, v int")
    assert sorted(map(str, (tuple(r) for r in t.first_groups(df, ["k"], [F.asc("v")], 3).collect()))) == sorted(map(str, [("a", 5), ("a", 1), ("b", 2), (None, 3), (None, 9)]))
    assert t.first_groups(df, ["k"], [F.asc("v")], 0).isEmpty()


def test_distinct_and_summary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "k string")
    assert [r.k for r in t.distinct_values(df, "k").collect()] == ["a", "b", "c"]
    (r,) = t.table_summary(df, "k", top=2).collect()
    assert (r.rows, r.assigned, r.unassigned) == (5, 4, 1) and [tuple(x) for x in r.top] == [(2, "b"), (1, "a")]
    (r,) = t.table_summary(df.limit(0), "k").collect()
    assert (r.rows, r.assigned, r.unassigned, r.top) == (0, 0, 0, [])


def test_metadata_by_built_key(spark):
    stage = spark.createDataFrame([("way/12", "old"), ("way/007", None), ("node/12", "n"), ("way/x1", "x"), (None, "z"), ("way/9", "kept")], "feature_id string, method string")
    found = spark.createDataFrame([(12, "new", "v1"), (7, "seven", None), (9, None, "v9")], "id long, method string, version string")
    rows = {r.feature_id: (r.method, r.version) for r in t.with_metadata(stage, found, stage_id="feature_id", found_id="id", prefix="way/", columns=["method", "version"]).collect()}
    assert rows == {"way/12": ("new", "v1"), "way/007": ("seven", None), "node/12": ("n", None), "way/x1": ("x", None), None: ("z", None), "way/9": ("kept", "v9")}


def test_previews(spark):
    rows = [(1, "a", 5.0, 1.0, rect(0, 0, 1, 1)), (2, "a", None, 2.0, rect(2, 2, 3, 3)), (3, "a", 9.0, None, RING), (4, "b", 99.0, None, rect(0, 0, 1, 1)), (5, "a", None, None, None)]
    df = spark.createDataFrame(rows, f"building_id int, town string, height double, floors double, geom {g.GEOMETRY}")
    ids = lambda *a: [r.building_id for r in rooftops.preview_subset(df, "town", *a).collect()]
    inside, outside = (g.box(*(F.lit(v) for v in b)) for b in ((1.5, 1.5, 2.5, 2.5), (50.0, 50.0, 51.0, 51.0)))
    assert ids("a", 2) == [3, 1] and ids("a", 9, inside) == [2] and ids("a", 2, outside) == [3, 1] and ids("none", 2, inside) == []
    out, counts = rooftops.preview_heights(df)
    assert {r.building_id: (r.elevation, r.elevation_from) for r in out.collect()} == {1: (5.0, "height"), 2: (6.4, "floors"), 3: (9.0, "height"), 4: (99.0, "height"), 5: (1.0, "default")}
    assert tuple(counts.first()) == (5, 3, 1, 1)


def test_sidecars_beside_rasters(spark):
    paths = [f"s3://x/San_Juan/bg1/{n}" for n in ("t_1_rgb_HIGH.tif", "t_1_mask_HIGH.tif", "t_2_rgb_LOW.tif", "t_3_rgb_HIGH.tif", "t_4_rgb_HIGH.tif", "odd.tif")]
    listing = files.raster_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    side = [(f"s3://x/San_Juan/bg1/{n}_meta.json", c) for n, c in (("t_1", ("2024-01-02", 50)), ("t_2", ("2017-01-01", None)), ("t_3", ("soon", 1)), ("t_9", ("2024-01-01", 1)))] + [("s3://x/San_Juan/bg1/t_4_meta.json", None)]
    sidecars = spark.createDataFrame(side, "path string, content struct<imagery_date:string,radius_m:int>")
    rows = {r.item_id: r for r in files.with_sidecars(listing, sidecars, ["imagery_date", "radius_m"], "2017-10-01", qualities=["HIGH"]).collect()}
    got = {k: (str(r.imagery_date), r.radius_m, r.post_cutoff, r.training_eligible, r.inference_eligible) for k, r in rows.items()}
    assert got == {"t_1_rgb_HIGH": ("2024-01-02", 50, True, True, True), "t_1_mask_HIGH": ("2024-01-02", 50, True, False, False), "t_2_rgb_LOW": ("2017-01-01", None, False, False, False), "t_3_rgb_HIGH": ("None", 1, False, False, False), "t_4_rgb_HIGH": ("None", None, False, False, False)}
    assert {r.municipio for r in rows.values()} == {"San Juan"}


def test_vintage_overlaps(spark):
    kind = "geoid string, minx double, miny double, maxx double, maxy double"
    old = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 2.0, 0.0, 3.0, 1.0), ("c", 5.0, 0.0, 6.0, 1.0)], kind)
    new = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 2.0, 0.0, 4.0, 1.0), ("d", 5.0, 0.0, 6.0, 1.0)], kind)
    r = census.vintage_overlaps(census.vintage_comparison(old, new)).first()
    assert (r.rows, r.avg_old_share, r.min_new_share, r.avg_new_share, r.max_new_share, r.min_distance_m) == (2, 1.0, 0.5, 0.75, 1.0, 0.0)


def test_best_per_source(spark):
    rows = [("p", "s1", 3, False), ("p", "s1", 1, False), ("p", "s2", 2, False), ("q", "s1", 1, False), ("q", "s2", 5, True), ("q", "s2", 4, True)]
    df = spark.createDataFrame(rows, "geom_id string, source string, gsd int, good boolean")
    best = lambda **k: sorted((r.geom_id, r["rank"], r.gsd) for r in spatial.best_per_source(df, geometry_id="geom_id", preferred=F.col("good"), order=[F.asc("gsd")], **k).collect())
    assert best() == [("p", 1, 1), ("p", 2, 2), ("p", 3, 3), ("q", 1, 4), ("q", 2, 5)]
    assert best(per_source="source") == [("p", 1, 1), ("p", 2, 2), ("q", 1, 4)]


def test_signatures(spark):
    kind = "item_id string, source string, asset_role string, acquired string, gsd_m double, minx double, miny double, maxx double, maxy double"
    rows = [("b", "one", "rgb", "d", 0.3, 0.0, 0.0, 1.0, 1.0), ("a", "two", "rgb", "d", 0.30001, 0.0, 0.0, 1.0, 1.0000001), ("c", "two", "rgb", "e", 0.3, 0.0, 0.0, 1.0, 1.0), ("d", "two", "rgb", "d", None, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, kind)
    rank = lambda first: F.when(F.col("source") == first, 0).otherwise(1)
    assert {r.item_id for r in catalog.signature_dedup(df, rank("one")).collect()} == {"b", "c", "d"} and {r.item_id for r in catalog.signature_dedup(df, rank("two")).collect()} == {"a", "c", "d"}
    links = spark.createDataFrame([(None, [("root", "r"), ("self", "s")]), ("h", [("self", "s")]), (None, None)], "href string, links array<struct<rel:string,href:string>>")
    assert [r[0] for r in links.select(catalog.self_link(F.col("href"), F.col("links"))).collect()] == ["s", "h", None]


def test_targets_and_their_caps(spark):
    kind = "minx double, miny double, maxx double, maxy double"
    foot = spark.createDataFrame([("i1", "rgb", 1, 0.0, 0.0, 2.0, 2.0), ("i2", "rgb", 2, 0.0, 0.0, 4.0, 4.0), ("i3", "nir", 3, 3.0, 3.0, 4.0, 4.0), ("far", "rgb", 0, 50.0, 50.0, 51.0, 51.0)], f"item string, role string, age int, {kind}")
    cells = spark.createDataFrame([("a", 0.5, 0.5, 1.5, 1.5), ("b", 3.2, 3.2, 3.8, 3.8)], f"cell string, {kind}")
    got = lambda **k: sorted(tuple(r) for r in imagery.fetch_targets(foot, cells, item_id="item", cell_id="cell", cell=1.0, order=[F.asc("age")], **k).collect())
    assert got() == [("i1", "a"), ("i2", "a"), ("i2", "b"), ("i3", "b")] and got(most_items=2) == [("i1", "a"), ("i2", "a"), ("i2", "b")]
    assert got(asset_group=["role"], most_assets=1) == [("i1", "a"), ("i2", "a"), ("i2", "b")] and got(most_assets=1) == [("i1", "a")]
    (best,) = imagery.best_footprint(foot, cells.where("cell = 'b'"), area_id="cell", order=[F.desc("age")], cell=1.0).select("item").collect()
    assert best.item == "i3"


def test_shares_pages_and_filters(spark):
    a, b = spark.createDataFrame([(True,), (None,), (False,), (True,)], "f boolean"), spark.createDataFrame([], "f boolean")
    assert {tuple(r) for r in imagery.share_flagged({"tract": a, "county": b}, "f").collect()} == {("tract", 4, 2, 50.0), ("county", 0, 0, None)}
    page = lambda n, skip=0: [r.id for r in imagery.example_page(spark.range(9), [F.desc("id")], n, skip).collect()]
    assert page(2) == [8, 7] and page(3, 7) == [1, 0] and page(3, 20) == []
    df = spark.createDataFrame([("72",), ("7",), (None,), ("07",)], "state string")
    assert [r.state for r in census.county_filter(df, "state", "07").collect()] == ["7", "07"]
    assert [r[0] for r in spark.createDataFrame([(33.0,), (32.0,), (0.0,)], "x double").select(imagery.chip_span(F.col("x"))).collect()] == [48, 32, 0]


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 5.0), ("b", 5.0), ("c", None)], "k string, value double")
    out = {(r.k, r.value): r.stretched for r in statistics.contrast_stretch(df, ["k"]).collect()}
    assert out["a", 2.0] == 0 and out["a", 98.0] == 1 and out["a", 50.0] == pytest.approx(0.5) and out["a", 0.0] == 0 and out["b", 5.0] is None and out["c", None] is None
    stats = {r.k: r for r in df.groupBy("k").agg(*statistics.area_stats("value"), *statistics.robust_range("value")).collect()}
    assert (stats["a"].min, stats["a"].mean, stats["a"].p50, stats["a"].p90, stats["a"].max, stats["a"].low, stats["a"].high) == (0, 50, 50, 90, 100, 5, 95)
    assert (stats["b"].low, stats["b"].high, stats["c"].p50, stats["c"].low) == (5, 5, None, None)


def test_projection_of_shapes(spark):
    df = spark.createDataFrame([(RING,), (None,)], f"geom {g.GEOMETRY}")
    rows = df.select(g.projected(F.col("geom")).alias("p")).collect()
    assert rows[0].p.srid == 3857 and rows[0].p.rings[0][1].x == pytest.approx(445277.963, abs=1e-2) and rows[1].p.rings is None


def test_files_with_a_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffList of tables,,\n\nTable  ID,Table\tTitle,Year\nB1,\"Age, \"\"sex\"\"\",2020\nB2,Añ\n".encode())
    (tmp_path / "b.csv").write_bytes(b"x\r\nYear,Table ID\r\n2021,B3\r\n")
    rows = files.read_after_preamble(spark, str(tmp_path / "*.csv"), ["Table ID", "Table Title", "Year", "None"]).collect()
    assert sorted(map(tuple, rows)) == [("B1", 'Age, "sex"', "2020", None), ("B2", "Añ", None, None), ("B3", None, "2021", None)]
    (tmp_path / "c.txt").write_bytes("x\nk;v\né;1\n".encode("latin-1"))
    assert [tuple(r) for r in files.read_after_preamble(spark, str(tmp_path / "c.txt"), ["k", "v"], sep=";", encoding="ISO-8859-1").collect()] == [("é", "1")]


def test_sheet_report(spark):
    from geoloom.plans import capacity

    grid = [["Title"], [None, "Período", "Capacidad (kW)", "Clientes NEM"], [None, "2020-01-01", "5", "1"], [None, "2019-03-01", "6", None], [None, "total", "11", None]]
    cells = [("s", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)] + [("empty", 0, 0, "x")]
    rows = {r.sheet: r for r in capacity.sheet_report(spark.createDataFrame(cells, "sheet string, row int, col int, value string"), period=["periodo"], capacity=["capacidad"], clients=["clientes"]).collect()}
    r = rows["s"]
    assert (r.rows, r.columns, r.header_row, r.labels, str(r.period_min), str(r.period_max)) == (5, 4, 1, ["periodo", "capacidad kw", "clientes nem"], "2019-03-01", "2020-01-01")
    assert (rows["empty"].header_row, rows["empty"].labels, rows["empty"].period_min) == (None, None, None)


def test_tables_are_listed(spark):
    spark.range(1).createOrReplaceTempView("listed_view")
    assert ("listed_view", "view") in {tuple(r) for r in files.tables_of(spark, "listed*").collect()}
    assert files.tables_of(spark, "nothing_like_it").isEmpty()


def test_resolution_text(spark):
    from geoloom.functions import scalars as s

    df = spark.createDataFrame([(0.3,), (0.076,), (0.999,), (1.0,), (1.5,), (2.25,), (10.0,), (0.0,), (None,)], "m double")
    assert [r[0] for r in df.select(s.resolution_text(F.col("m"))).collect()] == ["30 cm", "8 cm", "1 m", "1 m", "1.5 m", "2.25 m", "10 m", "unknown", "unknown"]


def test_items_as_json(spark):
    import json

    from .test_wkt import TWO

    rows = [("b", {"z": 1.0, "a": float("nan")}, [0.0, 1.0, 2.0, 3.0], TWO), ("n", None, None, None)]
    df = spark.createDataFrame(rows, f"id string, properties map<string,double>, bbox array<double>, geom {g.GEOMETRY}")
    got = [json.loads(r[0]) for r in df.select(catalog.item_json(df)).collect()]
    assert list(got[0]) == ["bbox", "geometry", "id", "properties", "type"] and got[0]["properties"] == {"a": None, "z": 1.0} and got[0]["bbox"] == [0, 1, 2, 3]
    shape = got[0]["geometry"]
    assert shape["type"] == "MultiPolygon" and [len(p) for p in shape["coordinates"]] == [2, 1] and shape["coordinates"][1][0][0] == [9, 9]
    assert got[1] == {"bbox": None, "geometry": None, "id": "n", "properties": None, "type": "Feature"}


def test_any_area(spark):
    kind = "minx double, miny double, maxx double, maxy double"
    left = spark.createDataFrame([(1, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 9.0, 9.0, 0.5, 0.5, 2.5, 1.0), (3, 9.0, 9.0, 8.0, 8.0, 8.5, 8.5)], f"k int, x double, y double, {kind}")
    areas = spark.createDataFrame([("b", 0.0, 0.0, 1.0, 1.0), ("a", 2.0, 0.0, 3.0, 1.0)], f"area string, {kind}")
    assert {r.k: r.area for r in spatial.assign_any(left, areas, left_id="k", area_id="area", x="x", y="y", cell=1.0, boxes=True).collect()} == {1: "b", 2: "a", 3: None}
    shapes = spark.createDataFrame([("p", 2, rect(0, 0, 2, 2)), ("p", 1, rect(0, 0, 2, 2)), ("p", 0, rect(0, 0, 1, 1)), ("q", 9, None)], f"k string, id int, geom {g.GEOMETRY}")
    rows = {r.k: tuple(r)[1:] for r in spatial.areas_of(shapes, ["k"], id_column="id").collect()}
    assert rows == {"p": (3, 9.0, 3.0, 1), "q": (1, 0.0, None, 9)}


def test_manifest_preview(spark):
    from geoloom.plans import manifest

    df = spark.createDataFrame([(1, "a", "HIGH", 2), (3, "b", "HIGH", 0), (1, "a", "HIGH", 5), (None, None, "LOW", 1)], "priority int, municipio string, required_quality string, points int")
    assert [tuple(r) for r in manifest.manifest_preview(df).collect()] == [(3, "b", "HIGH", 1, 0), (1, "a", "HIGH", 2, 7), (None, None, "LOW", 1, 1)]


def test_walk_keeps_only_links_that_can_lead_on(spark):
    from geoloom.plans import catalog
    from geoloom.sources.files import saved

    link = lambda rel, n: (rel, f"http://h/{n}")
    docs = [(f"http://h/{k}", [link("child", 0), link("child", k + 1), link("child", 100 + k)]) for k in range(6)]
    kept = []

    def save(df):
        out = saved(df, "walk")
        kept.append(out.count())
        return out

    frame = spark.createDataFrame(docs, "url string, links array<struct<rel:string,href:string>>")
    found = catalog.traversed(frame, spark.createDataFrame([("http://h/0",)], "url string"), save)
    assert sorted((r.url, r.level) for r in found.collect()) == [(f"http://h/{k}", k) for k in range(6)]
    assert kept == [18, 5]


def test_touched_cells_test_centres_once(spark, data, monkeypatch):
    from geoloom import shape_queries
    from geoloom.plans import imagery

    made, grid = [], imagery.label_grid
    monkeypatch.setattr(imagery, "label_grid", lambda *a, **k: made.append(1) or grid(*a, **k))
    assert shape_queries.touched_cells(spark, data).count() == 25
    assert made == [1]
