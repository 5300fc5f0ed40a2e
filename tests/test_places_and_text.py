import datetime
import math
import random
import unicodedata
import uuid
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.functions import scalars as s
from geoloom.plans import catalog
from geoloom.sources import files
from geoloom.sources.files import shared_folder

from .test_geometry import RING, rect


def test_hilbert_is_a_walk(spark):
    cells = spark.range(32).withColumnRenamed("id", "i").crossJoin(spark.range(32).withColumnRenamed("id", "j"))
    key = g.hilbert_key(F.col("i") + F.lit(0.5), F.col("j") + F.lit(0.5), (0.0, 0.0, 32.0, 32.0), 5)
    rows = sorted((r.k, r.i, r.j) for r in cells.select("i", "j", key.alias("k")).collect())
    assert [k for k, *_ in rows] == list(range(1024))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))
    flat = cells.select(g.hilbert_key(F.lit(1.0), F.col("j"), (1.0, 0.0, 1.0, 32.0), 5).alias("k"), g.hilbert_key(F.lit(None).cast("double"), F.col("j"), (0.0, 0.0, 1.0, 1.0)).alias("n"))
    assert flat.where("k IS NULL OR n IS NOT NULL").isEmpty()


def test_a_box_reads_few_files(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(-67, -65), rng.uniform(17, 19)) for i in range(20_000)] + [(-1, None, 18.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    files.write_by_place(df, path, "lon", "lat", 32)
    assert spark.read.parquet(path).columns == df.columns and spark.read.parquet(path).count() == len(rows)
    parts = [pq.ParquetFile(f) for f in sorted(Path(path.removeprefix("file:")).glob("*.parquet"))]
    assert len(parts) >= 24

    def touched(box):
        n = 0
        for f in parts:
            stats = [[f.metadata.row_group(k).column(c).statistics for c in (1, 2)] for k in range(f.num_row_groups)]
            n += any(x is not None and x.min <= box[2] and x.max >= box[0] and y.min <= box[3] and y.max >= box[1] for x, y in stats)
        return n

    boxes = [(x := rng.uniform(-67, -65.2), y := rng.uniform(17, 18.8), x + 0.2, y + 0.2) for _ in range(40)]
    assert sum(map(touched, boxes)) / len(boxes) <= 0.15 * len(parts)
    files.write_by_place(df.where("id < 0"), path, "lon", "lat", 2)
    assert spark.read.parquet(path).count() == 1


def test_folding_equals_nfkd_for_all_characters(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 64])) for i in range(0, len(points), 64)] + [None, "", "plain", "ÀÉ ﬁ ½ ß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", s.folded("t").alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else unicodedata.normalize("NFKD", t.casefold()).encode("ascii", "ignore").decode())
    labels = spark.createDataFrame([("  Año/Período (kW)!",), ("Straße № 5",), ("NaN",), ("Ǻngström ﬂow",), (None,), ("日本",)], "t string")
    assert [r[0] for r in labels.select(s.normal_label(F.col("t"))).collect()] == ["ano periodo kw", "strasse o 5", "", "angstrom flow", None, ""]


def test_canonical_json_is_sorted_at_any_depth(spark):
    schema = "b map<string,double>, a struct<z:double,y:array<double>>, m map<string,map<string,int>>, t timestamp, x binary, e map<string,int>"
    t = datetime.datetime(2024, 2, 3, 4, 5, 6)
    rows = [({"k": math.nan, "a": 1.5, "n": None}, (math.inf, [1.0, math.nan, None]), {"q": {"b": 1, "a": 2}, "p": {}}, t, bytearray(b"\x00\xff"), None), (None, None, None, None, None, {})]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(s.canonical_json({c: F.col(c) for c in df.columns}, of=df)).collect()]
    assert got == [
        '{"a":{"y":[1.0,null,null],"z":null},"b":{"a":1.5,"k":null,"n":null},"e":null,"m":{"p":{},"q":{"a":2,"b":1}},"t":"2024-02-03T04:05:06","x":"00ff"}',
        '{"a":null,"b":null,"e":{},"m":null,"t":null,"x":null}',
    ]


def test_exact_scan_is_newest_first(spark):
    box = lambda a, b, c, d: {"xmin": float(a), "ymin": float(b), "xmax": float(c), "ymax": float(d)}
    rows = [("old", box(0, 0, 4, 4), "2020", RING), ("none", box(0, 0, 1, 1), None, rect(0, 0, 1, 1)), ("new", box(0, 0, 1, 1), "2024", rect(0, 0, 1, 1)), ("court", box(1, 1, 3, 3), "2025", rect(1.5, 1.5, 2, 2)), ("far", box(9, 9, 10, 10), "2023", rect(9, 9, 10, 10)), ("nobox", None, "2022", rect(0, 0, 1, 1))]
    df = spark.createDataFrame(rows, f"id string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, datetime string, geom {g.GEOMETRY}")
    area = F.lit(None).cast(g.GEOMETRY)
    area = g.box(*(F.lit(v) for v in (0.2, 0.2, 0.8, 0.8)))
    scan = lambda d: [r.id for r in files.exact_scan(d, (0.2, 0.2, 0.8, 0.8), area).collect()]
    assert scan(df) == ["new", "old", "none"]
    assert scan(df.drop("bbox")) == ["new", "nobox", "old", "none"]
    assert set(scan(df.drop("datetime"))) == {"new", "old", "none"}


def test_later_frames_win(spark):
    kind = "id string, collection string, datetime string, properties map<string,string>, n int"
    a = spark.createDataFrame([("1", "c", "2020", None, 1), ("1", " c ", "2021", None, 2), ("2", None, None, {"datetime": "2023"}, 3), ("3", "", " ", {"start_datetime": "2019"}, 4), (None, "c", "2024", None, 5), (" ", "c", "2024", None, 6)], kind)
    b = spark.createDataFrame([("2", " ", "2022", None, 7), ("4", "d", None, None, 8)], kind)
    got = [(r.id, r.n) for r in catalog.merged_items([a, b], order=[F.desc("n")]).collect()]
    assert got == [("2", 7), ("1", 2), ("3", 4), ("4", 8)]


def test_boxes_of_any_kind_and_the_consolidated_row(spark):
    four = [1.0, 2.0, 3.0, 4.0]
    for value, kind in ((four, "array<double>"), (dict(zip(("xmin", "ymin", "xmax", "ymax"), four)), "struct<xmin:double,ymin:double,xmax:double,ymax:double>"), (dict(zip(("minx", "miny", "maxx", "maxy"), four)), "struct<minx:double,miny:double,maxx:double,maxy:double>"), (dict(zip(("xmin", "ymin", "xmax", "ymax"), four)), "map<string,double>")):
        df = spark.createDataFrame([(value,), (None,)], f"bbox {kind}")
        assert [tuple(r) for r in df.select(*catalog.box_bounds(df).values()).collect()] == [tuple(four), (None,) * 4]
    asset = "array<struct<name:string,href:string,title:string,roles:array<string>>>"
    rows = [
        ("a", [("thumbnail", "t.png", None, None), ("analytic_ms", "m.tif", None, None)], four, None), ("b", [("preview", "p.png", None, None)], None, RING), ("gone", None, None, None), ("far", None, [50.0, 50.0, 51.0, 51.0], None),
        ("court", None, four, rect(1.5, 1.5, 2, 2)),
    ]
    df = spark.createDataFrame(rows, f"id string, assets {asset}, bbox array<double>, geom {g.GEOMETRY}")
    got = {r.item_id: r for r in catalog.consolidated_rows(df, "src", g.box(*(F.lit(v) for v in (0.0, 0.0, 0.9, 5.0)))).collect()}
    assert set(got) == {"b"} and list(got["b"].asDict()) == catalog.CONSOLIDATED and (got["b"].bbox_minx, got["b"].bbox_maxy) == (0.0, 4.0)
    got = {r.item_id: r for r in catalog.consolidated_rows(df, "src", g.box(*(F.lit(v) for v in (0.0, 0.0, 9.0, 9.0)))).collect()}
    assert set(got) == {"a", "b", "court"}
    assert (got["a"].visual_asset_href, got["a"].analytic_asset_href, got["a"].thumbnail_asset_href, got["a"].asset_count) == ("m.tif", "m.tif", "t.png", 2)
    assert got["a"].geometry.rings[0][0].x == pytest.approx(1) and got["b"].visual_asset_href is None
