import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalars as s
from geoloom.operators import tables as t
from geoloom.plans import capacity, catalog, census, manifest
from geoloom.sources import files


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    L = F.lit
    null = F.lit(None)
    r = one(
        spark,
        geoid=s.geoid((L("72"), 2), (L("1"), 3), (L("123456789"), 6)),
        sentinel=s.without_sentinel(s.numeric(L("-666666666"))),
        bad=s.numeric(L("x")),
        zero=s.safe_ratio(L(1), L(0)),
        half=s.safe_ratio(L(1), L(2)),
        all_null=s.row_sum([null.cast("int"), null.cast("int")], True),
        some=s.row_sum([null.cast("int"), L(3)], True),
        plain=s.row_sum([null.cast("int"), null.cast("int")], False),
        div=s.diversity([L(1.0), L(1.0)], L(2.0)),
        div_null=s.diversity([L(1.0), null.cast("double")], L(2.0)),
        label=s.normal_label(L("  Año/Período (kW)!")),
        tokens=s.has_tokens(L("installed capacity kw"), ["capacity"], ["clients"]),
        slug=s.slug(L("Juana Díaz")),
        filled=s.first_filled(L(" "), null.cast("string"), L("b")),
        after=s.after(null.cast("timestamp"), "2017-09-20"),
        parts=s.date_of_parts(F.struct(L(2020).alias("year"), L(2).alias("month"), L(29).alias("day"))),
        part=s.date_of_parts(F.struct(L(2020).alias("year"), null.cast("int").alias("month"), L(29).alias("day"))),
        rel=s.resolve_href(L("https://h/a/b/c.json?x=1"), L("../d.json")),
        root=s.resolve_href(L("https://h/a/b/c.json"), L("/d.json")),
        here=s.resolve_href(L("https://h/a/b/c.json"), L("./d.json")),
        abs_=s.resolve_href(L("https://h/a"), L("s3://b/c")),
        signed=s.without_query(L("https://h/a?sig=1"), "h"),
        other=s.without_query(L("https://g/a?sig=1"), "h"),
        size=s.size_label(L(1536)),
        big=s.size_label(L(5 * 1024**5)),
        pixel=s.allowed_pixel(L(175), L(0.1)),
        pixel2=s.allowed_pixel(L(100), L(0.1)),
        pixel3=s.allowed_pixel(L(2000), L(0.1)),
        gsd=s.resolution_cm(null.cast("string"), L("naip"), {"naip": 60.0}),
        up=s.elevation(null.cast("double"), L(3.0)),
        low=s.elevation(L(0.2), null.cast("double")),
        radius=s.equal_area_radius(F.pi() * 99.5**2),
    )
    assert (r.geoid, r.sentinel, r.bad, r.zero, r.half, r.all_null, r.some, r.plain) == ("72001123456789", None, None, None, 0.5, None, 3, 0)
    assert (r.div, r.div_null, r.label, r.tokens, r.slug, r.filled, r.after) == (0.5, None, "ano periodo kw", True, "juana_diaz", "b", False)
    assert (r.parts, r.part) == (dt.date(2020, 2, 29), None)
    assert (r.rel, r.root, r.here, r.abs_) == ("https://h/a/d.json", "https://h/d.json", "https://h/a/b/d.json", "s3://b/c")
    assert (r.signed, r.other, r.size, r.big) == ("https://h/a", "https://g/a?sig=1", "1.5 KB", "5120.0 TB")
    assert (r.pixel, r.pixel2, r.pixel3, r.gsd, r.up, r.low, r.radius) == (0.25, 0.1, None, 60.0, pytest.approx(9.6), 1.0, 100)


def test_choosing_rows(spark):
    df = spark.createDataFrame([(1, "b", None), (1, "a", 3), (1, "c", 2), (2, None, None), (None, "z", 1)], "k int, name string, v int")
    first = t.first_per(df, ["k"], [F.desc_nulls_last("v")]).collect()
    assert {(r.k, r.v) for r in first} == {(1, 3), (2, None), (None, 1)}
    known = {r.k: (r["name"], r.v) for r in t.first_values(df, ["k"], [F.asc_nulls_last("name")], ["name", "v"]).collect()}
    assert known == {1: ("a", 3), 2: (None, None), None: ("z", 1)}
    later = t.last_source_wins([df.select("k", "v"), spark.createDataFrame([(1, 9), (None, 8)], "k int, v int")], ["k"]).collect()
    assert {(r.k, r.v) for r in later} == {(1, 9), (2, None)}
    new = t.updated(df.dropDuplicates(["k"]).select("k", F.lit("old").alias("s")), spark.createDataFrame([(1, "new"), (2, None)], "k int, s string"), ["k"], ["s"])
    assert {(r.k, r.s) for r in new.collect()} == {(1, "new"), (2, "old"), (None, "old")}
    assert t.with_missing(df, {"v": "int", "w": "double"}).dtypes[-1] == ("w", "double")
    assert t.kept_columns(df, ["v", "nope", "v"], level=F.lit("x")).columns == ["level", "v"]
    with pytest.raises(ValueError, match="nope"):
        t.require_columns(df, ["k", "nope"])
    with pytest.raises(ValueError, match="one row per"):
        t.joined_one_to_one(df, df.dropDuplicates(["k"]), ["k"])


def test_samples(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    split = t.split_of(df, "seed", "id", 0.21)
    assert split.where("is_validation").count() == 21 and split.count() == 100
    by = t.split_of(df, "seed", "id", 0.5, ["g"]).where("is_validation").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in by} == {0: 17, 1: 17, 2: 17}
    assert [r.id for r in t.seeded_sample(df, "a", "id", 5).collect()] == [r.id for r in t.seeded_sample(df, "a", "id", 5).collect()]
    assert {5, 7} <= {r.id for r in t.picks_and_random(df, "id", [5, 7], "a", 3).collect()} and t.picks_and_random(df, "id", [5], "a", 3).count() == 4
    assert t.balanced_cap(df, "g", [F.col("id")], 10).count() == 10
    assert t.balanced_sample(df, "g", [F.col("id")], 8, 2).count() == 48
    assert {r.key: r.state for r in t.file_set_report(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("b",), ("c",)], "key string"), "key").collect()} == {"a": "only_a", "b": "both", "c": "only_b"}
    ranks = t.drop_at_ranks(df, [F.col("id")], [1, 3], ["g"]).where("g = 0").orderBy("rank").limit(2).collect()
    assert [(r.id, r.rank) for r in ranks] == [(3, 1), (9, 2)]
    top = t.top_with_forced(df.withColumn("name", F.concat(F.lit("N"), "id")), [F.desc("id")], 2, F.col("g") == 1, "name", ["n5", "N97"])
    assert {r["name"] for r in top.collect()} == {"N97", "N94", "N5"}
    counts = t.share_of_total(t.value_counts(df, "g")).collect()
    assert sum(r.pct for r in counts) == pytest.approx(100, abs=0.01)


def test_coverage(spark):
    areas = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "m string, id int")
    report = t.coverage(areas, spark.createDataFrame([(1,), (2,)], "id int"), ["id"], ["m"])
    assert {tuple(r) for r in report.collect()} == {("a", 2, 2, 0), ("b", 1, 0, 1)}
    with pytest.raises(ValueError, match="b.*c"):
        t.assert_covered(report, "m", ["a", "c"])


def test_levels_and_blocks(spark):
    assert census.level("Block Group").digits == 12 and census.level("counties").name == "county"
    with pytest.raises(ValueError):
        census.level("planet")
    raw = spark.createDataFrame([("72", "1", "123", "1005"), (None, "1", "1", "1")], "state string, County string, ` tract` string, block string")
    r = census.block_identifiers(raw).collect()
    assert (r[0].block_geoid, r[0].bg_geoid, r[0].tract_geoid, r[0].county_geoid) == ("720010001231005", "720010001231", "72001000123", "72001") and r[1].block_geoid is None
    with pytest.raises(ValueError, match="BLOCK"):
        census.block_identifiers(raw.drop("block"))
    status = spark.createDataFrame([("exact",), ("near",), ("new",)], "status string")
    assert "overlap" in census.vintage_guidance(status).first().advice and "same" in census.vintage_guidance(status.limit(0)).first().advice
    cat = spark.createDataFrame([("B01001. SEX", "no 150"), ("B02001", None), ("C03", "150")], "id string, r string")
    assert [x.id for x in census.restricted_tables(cat, "r", "id", ["B01001", "B02001"], "150").collect()] == ["B01001. SEX"]


def test_manifest(spark):
    rows = [("a", "ok", "LOW", dt.date(2022, 1, 1)), ("a", None, "HIGH", None), ("b", "error", None, None), ("a", "ok", "HIGH", dt.date(2010, 1, 1))]
    probe = spark.createDataFrame(rows, "tile_id string, status string, quality string, imagery_date date")
    got = {r.tile_id: (r.status, r.quality, r.imagery_date) for r in manifest.collapsed_probe(probe).collect()}
    assert got == {"a": ("ok", "HIGH", dt.date(2010, 1, 1)), "b": ("error", None, None)}
    assert [r.quality for r in manifest.fetch_candidates(probe, "2017-09-20", ["HIGH", "LOW"]).collect()] == ["LOW"]
    work = spark.createDataFrame([(i // 10, i, i % 2) for i in range(100)], "priority int, id int, cost int")
    for cap in (0, 1, 12, 15, 50, 99):
        want, run = [], 0
        for i in range(100):
            if run < cap:
                want.append(i)
            run += i % 2
        assert sorted(r.id for r in manifest.within_budget(work, ["priority", "id"], F.col("cost"), cap).collect()) == want
    key = manifest.cache_key(F.lit("layers"), F.lit(-66.123456789), F.lit(18.0), F.lit(100), F.lit("FULL"), F.lit(0.5), F.lit("HIGH"))
    assert one(spark, k=key).k == "layers__-66.123457__18.000000__100__FULL__0.5__HIGH"
    cached = spark.createDataFrame([("x",)], "cache_key string")
    assert [r.cache_key for r in manifest.uncached(spark.createDataFrame([("x",), ("y",)], "cache_key string"), cached).collect()] == ["y"]
    landed = spark.createDataFrame([(1, "p", None, True, None), (2, "q", None, False, 4326), (3, None, "boom", None, None)], "id int, path string, error string, existed boolean, epsg int")
    out = {r.id: (r.status, r.epsg) for r in manifest.fetch_outcomes(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"), landed, ["id"]).collect()}
    assert out == {1: ("reused", 3857), 2: ("fetched", 4326), 3: ("error", 3857), 4: ("error", 3857)}


def test_tile_manifest(spark):
    b = spark.createDataFrame([(-66.0 + i * 1e-4, 18.4, "x" if i % 3 else "y") for i in range(30)], "lon double, lat double, name string")
    cells = manifest.occupied_cells(b, lon="lon", lat="lat", name="name", edge_m=150.0)
    pts = cells.limit(1).select(F.col("centre_x_m").alias("x_m"), F.col("centre_y_m").alias("y_m"))
    c = cells.orderBy(F.desc("centre_x_m")).first()
    seeds = spark.createDataFrame([(c.centre_x_m - 1, c.centre_y_m - 1, c.centre_x_m + 1, c.centre_y_m + 1)], "minx double, miny double, maxx double, maxy double")
    tiles = manifest.tile_manifest(cells, pts, seeds=seeds, edge_m=150.0, quality="HIGH").collect()
    assert sum(r.building_count for r in tiles) == 30 and {3} <= {r.priority for r in tiles} and sum(r.points for r in tiles) == 1


def test_catalog(spark, tmp_path):
    n = iter(range(10_000))

    def save(d):
        d.write.parquet(path := f"{tmp_path}/{next(n)}")
        return spark.read.schema(d.schema).parquet(path)

    assets = [("visual-blocked", "a.tif", "x", ["data"]), ("rgb", "b.tif", "x", ["overview"]), ("B1", "c.tif", None, ["data"])]
    df = spark.createDataFrame([(assets,), ([],), (None,)], "assets array<struct<name:string,href:string,title:string,roles:array<string>>>")
    pick = lambda **o: [r[0].href if r[0] else None for r in df.select(catalog.picked_asset(F.col("assets"), **{"exact": [], "roles": [], "keywords": [], "blocked": ["blocked"]} | o)).collect()]
    assert pick(exact=["visual-blocked"]) == ["a.tif", None, None]  # an exact name isn't blocked
    assert pick(roles=["data"])[0] == "c.tif" and pick(keywords=["b.tif"])[0] == "b.tif" and pick(fallback=True)[0] == "b.tif" and pick()[0] is None
    # asset by asset, not role by role; names as written; without a link nothing is offered; a title blocks nothing
    assert pick(roles=["overview", "data"], blocked=[])[0] == "a.tif" and pick(exact=["RGB"])[0] is None
    more = spark.createDataFrame([([("a", " ", "x", ["data"]), ("b", "b.tif", "blocked", ["Data"])],)], df.schema)
    choice = catalog.picked_asset(F.col("assets"), ["a"], ["data"], [], ["blocked"])
    assert more.select(choice["name"]).first()[0] == "b"
    docs = spark.createDataFrame(
        [("http://h/c.json", [("child", "a/c.json"), ("self", "c.json"), ("item", "gone.json")]), ("http://h/a/c.json", [("item", "i.json"), ("child", "../c.json")]), ("http://h/a/i.json", None), ("http://h/x.json", [])],
        "url string, links array<struct<rel:string,href:string>>",
    )
    roots = spark.createDataFrame([("http://h/c.json",)], "url string")
    seen = catalog.traversed(docs, roots, save)
    assert {(r.url, r.level) for r in seen.collect()} == {("http://h/c.json", 0), ("http://h/a/c.json", 1), ("http://h/a/i.json", 2)}
    chain = spark.createDataFrame([(f"http://h/{i}", [("child", f"{i + 1}"), ("item", f"x{i}"), ("child", None)]) for i in range(8)] + [(f"http://h/x{i}", [("child", "0")]) for i in range(8)], docs.schema)
    walk = catalog.traversed(chain, chain.where("url = 'http://h/0'"), save, prune=F.col("url") != "http://h/6", keep_item=~F.col("url").endswith("x2"))
    got = {(r.url[9:], r.level, r.kind) for r in walk.collect()}
    assert got == {(str(i), i, "catalog") for i in range(7)} | {(f"x{i}", i + 1, "item") for i in range(6) if i != 2}
    schema = "source string, item_id string, acquired timestamp, asset_href string"
    ok = lambda: spark.createDataFrame([("s", "1", None, "a"), ("s", "1", dt.datetime(2020, 1, 1), "b")], schema)

    def bad():
        raise RuntimeError("down")

    rows, notes = catalog.consolidated({"s": ok, "t": bad}, files.empty(spark, schema))
    assert [r.asset_href for r in rows.collect()] == ["b"] and notes == [("s", "ok", 2), ("t", "RuntimeError: down", 0)]
    cats = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 5.0, 5.0, 6.0, 6.0), ("c", None, None, None, None), ("d", None, None, None, None)], "url string, minx double, miny double, maxx double, maxy double")
    kids = spark.createDataFrame([("c", 0.5, 0.5, 2.0, 2.0)], "parent string, minx double, miny double, maxx double, maxy double")
    assert {r.url: r.status for r in catalog.relevance(cats, kids, (0.0, 0.0, 1.0, 1.0)).collect()} == {"a": "own", "b": "outside", "c": "child", "d": "unknown"}


def test_capacity(spark):
    # fixed values: the published score's example
    r = one(spark, s=capacity.example_score(F.lit(60), F.lit(22.359622810947585), F.lit(1), F.lit(1.2608626618033767), F.lit(60.0), F.lit(0.35)))
    assert r.s == 11.063
    grid = [["title", None, None], ["Period", "Installed Capacity (kW)", "Clients"], ["2017-01-01", "10", "5"], ["2017-02-01", "bad", "5"], ["2017-03-01", "30", "7"], ["2017-03-15", "99", "9"], ["2017-06-01", "60.5", "8"], ["total", "1", "1"]]
    cells = spark.createDataFrame([("m", i, j, v) for i, row in enumerate(grid) for j, v in enumerate(row)], "sheet string, row int, col int, value string")
    rec = capacity.grid_records(cells, period=["period"], capacity=["capacity", "kw"], clients=["clients"])
    q = capacity.quarterly(rec).orderBy("period").collect()
    assert [(r.quarter_key, r.quarter_label, str(r.quarter_end), r.client_delta) for r in q] == [("2017-Q1", "Q1 2017", "2017-03-31", None), ("2017-Q2", "Q2 2017", "2017-06-30", 1)]
    assert q[1].capacity_growth_pct == pytest.approx((60.5 - 30) / 30 * 100)
    g = capacity.growth(rec, "capacity_mw").first()
    assert (g["first"], g["last"]) == (0.01, 0.0605) and capacity.sheet_summary(cells).first().rows == 8


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"Table  ID","Some\nTitle"\nB1,"x, ""y"""\n'.encode())
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Table ID", "Some Title"] and tuple(df.first()) == ("B1", 'x, "y"')
    (tmp_path / "b.txt").write_text("72|a\n01|b\n")
    assert files.read_delimited(spark, str(tmp_path / "b.txt"), sep="|", columns=["s", "n"], keep=F.col("s") == "72").count() == 1
    (tmp_path / "c.json").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    assert files.read_lines_of_json(spark, str(tmp_path / "c.json"), "id int").where("id IS NOT NULL").count() == 2
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "x.json").write_text('{\n"q": "HIGH"}')
    (tmp_path / "side" / "y.json").write_text("broken")
    assert sorted(str(r.content.q) if r.content else "None" for r in files.read_sidecars(spark, str(tmp_path / "side"), "q string").collect()) == ["HIGH", "None"]
    pay = spark.createDataFrame([(json.dumps([["NAME", "B1", "state"], ["a", "5", "72"], ["b", None, "72"]]),), ("[]",), ("bad",), (None,)], "body string")
    assert [tuple(r) for r in files.table_of_arrays(pay, "body", ["B1", "NAME", "B9"]).collect()] == [("5", "a", None), (None, "b", None)]
    listing = spark.createDataFrame([("/r/San_Juan/720010001231/t_1_2_rgb_HIGH.tif",), ("/r/x.tif",)], "path string")
    assert [(r.tile_id, r.layer, r.quality, r.bg, r.municipio) for r in files.raster_files(listing).collect()] == [("t_1_2", "rgb", "HIGH", "720010001231", "San_Juan")]
    df, built = files.reused_or_built(spark, str(tmp_path / "t"), lambda: spark.range(3).toDF("id"))
    again, rebuilt = files.reused_or_built(spark, str(tmp_path / "t"), lambda: spark.range(9).toDF("id"))
    assert (built, rebuilt, again.count()) == (True, False, 3)
    files.write_sorted(spark.range(100).toDF("id"), str(tmp_path / "s"), ["id"], 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    files.append_ledger(spark.createDataFrame([("x", 1)], "tile_id string, more int"), str(tmp_path / "l"), spark.createDataFrame([], "ts timestamp, tile_id string").schema)
    assert spark.read.parquet(str(tmp_path / "l")).columns == ["ts", "tile_id"]
    ras = spark.createDataFrame([(dt.date(2020, 1, 1), "HIGH", "rgb", 3, 1.0, 3857), (None, "HIGH", "rgb", 3, 1.0, 3857)], "imagery_date date, quality string, layer string, bands int, gsd_m double, epsg int")
    assert [(r.training_eligible, r.inference_eligible) for r in files.eligible(ras, "2017-09-20", qualities=["HIGH"], layers=["rgb"]).collect()] == [(True, True), (False, False)]
    boxes = spark.createDataFrame([((0.0, 0.0, 1.0, 1.0),), ((5.0, 5.0, 6.0, 6.0),)], "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    boxes.write.parquet(str(tmp_path / "b"))
    hit = files.overlapping_box(spark.read.parquet(str(tmp_path / "b")), (0.5, 0.5, 2.0, 2.0))
    assert hit.count() == 1 and "PushedFilters: [IsNotNull(bbox.xmin)" in hit._jdf.queryExecution().executedPlan().toString()


def test_streaming_equals_batch(spark, data, tmp_path):
    from geoloom.fixtures import SQL, fixture
    from geoloom.streaming import ledger

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.sql(SQL["ledger"], events=spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data))
    batch = fixture(spark, data, "ledger")
    got = ledger.drain(ledger.latest_status(stream), "latest", str(tmp_path / "c1")).collect()
    want = {r.tile_id: r.ts for r in batch.groupBy("tile_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.tile_id: r.ts for r in got} == want
    once = ledger.drain(ledger.once_per_key(stream, ["tile_id"], "100000 days"), "once", str(tmp_path / "c2"), "append")
    assert once.count() == batch.select("tile_id").distinct().count()
    by_day = ledger.drain(ledger.counts_by_time(stream, "1 day", "1 hour", ["status"]), "days", str(tmp_path / "c3"), "append")
    assert 0 < by_day.agg(F.sum("n")).first()[0] <= batch.count()


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_links(spark):
    from urllib.parse import urljoin

    bases = ["http://h/a.json", "http://h", "https://h.org/a/b/c.json?x=/y/#z", "s3://b/k/", "http://h/a/b/c/d/e/f.json"]
    hrefs = ["../x.json", "../../../../../x.json", "./x/./y/../z", "x", "/r/../s.json", "..", ".", "a/..", "x?q=../y", "x#../y", "http://g/../z", "s3://q/w"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.withColumn("got", s.resolve_href(F.col("b"), F.col("h"))).collect():
        b = r.b if r.b.count("/") > 2 else r.b + "/"
        want = r.h if "://" in r.h else urljoin(b.replace("s3:", "http:"), r.h).replace("http:", r.b.split(":")[0] + ":", 1)
        assert r.got == want, (r.b, r.h)
    null = spark.createDataFrame([(None, "x"), ("http://h/", None)], "b string, h string")
    assert [r[0] for r in null.select(s.resolve_href(F.col("b"), F.col("h"))).collect()] == [None, None]


def test_sinks(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, 'a "q", b', float("nan")), (2, None, 1.5)], "id int, t string, v double")
    r = files.write_table(df, "sunk", str(tmp_path / "p"), nulls={"has_pv": "boolean"}).first()
    assert (r.table, r.rows) == ("sunk", 2) and spark.read.parquet(str(tmp_path / "p")).columns == ["id", "t", "v", "has_pv"]
    assert files.write_table(df.limit(1), "sunk").first().rows == 1
    assert files.preview(spark, "sunk")[0][0] == ("id", "int")
    files.require_tables(spark, ["sunk"])
    df.createOrReplaceTempView("seen")
    assert [files.drop_relation(spark, n) for n in ("seen", "sunk", "sunk")] == ["view", "table", "none"]
    with pytest.raises(ValueError, match="sunk"):
        files.require_tables(spark, ["sunk"])
    with pytest.raises(ValueError):
        files.preview(spark, "sunk")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(r.t or "" for r in files.read_delimited(spark, str(tmp_path / "c")).collect()) == ["", 'a "q", b']
    files.write_lines_of_json(df, str(tmp_path / "j"))
    assert {r.id for r in files.read_lines_of_json(spark, str(tmp_path / "j"), "id int, t string").collect()} == {1, 2}
    files.write_report(spark.createDataFrame([("b", 1.0), ("a", float("nan")), ("c", None)], "key string, value double"), str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).first().value
    assert json.loads(text) == {"a": None, "b": 1.0, "c": None} and text.index('"a"') < text.index('"b"')
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "one"))
    spark.range(3).write.parquet(str(tmp_path / "two"))
    spark.range(0).write.parquet(str(tmp_path / "none"))
    paths = [str(tmp_path / n) for n in ("one", "gone", "none", "two")]
    assert {(r.id, r.x) for r in files.combined(spark, paths, ["id"]).collect()} == {(0, 1), (1, 1), (2, None)}
    assert files.combined(spark, paths[1:3]) is None


def test_stream_of_a_folder(spark, tmp_path):
    from geoloom.queries import STREAM_SQL, stream_spend  # noqa: F401

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    both = [sorted(map(tuple, stream_spend(spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001")]
    assert both[0] == both[1] and len(both[0]) == 10


def test_rooftops(spark):
    from geoloom.plans import rooftops as r

    b = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "building_id int, m string")
    pairs = spark.createDataFrame([(1, 0.5), (1, 0.25)], "building_id int, overlap double")
    flags = r.pv_flags(b, pairs.limit(0), pairs)
    assert {(x.building_id, x.has_pv_mapped, x.has_pv_detected, x.detected_count, x.detected_area) for x in flags.collect()} == {(1, False, True, 2, 0.75), (2, False, False, 0, 0.0), (3, False, False, 0, 0.0)}
    assert {(x.m, x.buildings, x.detected, x.rate) for x in r.flag_summary(flags, ["m"]).collect()} == {("x", 2, 1, 0.5), (None, 1, 0, 0.0)}
    dets = spark.createDataFrame([(3.0, 1.0, 0.0), (500.0, 9.0, 1.0), (10.0, 10.0, 1.0), (None, 1.0, 1.0), (2.9, 1.0, 1.0)], "a double, l double, s double")
    assert [x.a for x in r.detections_kept(dets, "a", "l", "s").collect()] == [500.0]
    m = spark.createDataFrame([(1, "ready", 1), (2, "stale", 9), (3, "ready", None), (4, "ready", 5)], "tile_id int, manifest_status string, priority int")
    assert [x.tile_id for x in r.by_status(m).collect()] == [4, 1, 3] and r.by_status(m, False).count() == 4
    new = r.with_candidates(m, spark.createDataFrame([(4, 7)], "tile_id int, priority int"), ["priority"]).collect()
    assert [(x.tile_id, x.priority) for x in new] == [(4, 7)]
    assert r.chosen(m, "manifest_status", [F.col("tile_id")], None).first().tile_id == 1 and r.chosen(m, "manifest_status", [F.col("tile_id")], "STALE").first().tile_id == 2
    assert r.computed_if_missing(m, {"priority": F.lit(0), "more": F.lit(1)}).columns == [*m.columns, "more"]
    assert s.canonical_json({"b": F.lit(1), "a": s.finite(F.lit(float("nan")))}) is not None
    row = one(spark, j=s.canonical_json({"b": F.lit(1), "a": s.finite(F.lit(float("nan")))}), k=s.coerced_list(F.lit('["x", "y"]')), m=s.coerced_map(F.lit('{"p": 1}')), n=s.coerced_map(F.lit("no")), w=s.whole_number(F.lit("3.0")), h=s.whole_number(F.lit("3.5")))
    assert (row.j, row.k, row.m, row.n, row.w, row.h) == ('{"a":null,"b":1}', ["x", "y"], {"p": "1"}, {}, 3, None)


def test_spatial_pairs_met(spark):
    """Small shapes don't meet in the cells of large ones: what meets is in proportion to what is returned."""
    import random

    from geoloom.operators import spatial

    rng = random.Random(1)
    at = lambda n, w: [(i, x := rng.uniform(0, 10), y := rng.uniform(0, 10), x + w * rng.uniform(0.5, 1), y + w * rng.uniform(0.5, 1)) for i in range(n)]
    schema = "id int, minx double, miny double, maxx double, maxy double"
    rows = at(1500, 0.05) + [(5000 + i, *r[1:]) for i, r in enumerate(at(30, 3.0))]
    other = at(1500, 0.04) + [(5000 + i, *r[1:]) for i, r in enumerate(at(30, 2.0))] + [(9999, -1.0, -1.0, 11.0, 11.0)]
    left, right = (spark.createDataFrame(r, schema) for r in (rows, other))
    want = {(a[0], b[0]) for a in rows for b in other if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    got = [(r.a, r.b) for r in spatial.candidate_pairs(left, right, cell=0.05).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.meetings(left, right, cell=0.05).count() <= 5 * len(want)
