"""Readers and writers: delimited text, JSON in its variants, file listings, sorted Parquet, ledgers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import envelope, hilbert_key, intersects


def clean_names(df: DataFrame) -> DataFrame:
    """Column names with white space collapsed and a byte order mark removed."""
    return df.toDF(*(" ".join(c.replace("﻿", "").split()) for c in df.columns))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, if it is unset, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, with the same partitions for all that use it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges_of(df: DataFrame, parts: int | None) -> int:
    """The number of ranges into which a table is dealt: as given, else that of shuffle partitions, which goes with the data; four at least."""
    return parts or max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as there are shuffle partitions: for few bytes with much work on each row, as a file of them is read by one task."""
    return df.repartition(ranges_of(df, None))


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files; new ones in a folder follow."""
    schema = spark.read.parquet(path).schema
    files = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    parent, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].path.rstrip("/").rpartition("/")[2] == name:
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    return spark.readStream.schema(schema).parquet(path)


def read_delimited(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "UTF-8", columns: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """All columns as text, quoted newlines allowed; names from the header, or given and then a header is data."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    df = clean_names(reader.option("header", True).csv(path)) if columns is None else reader.csv(path, schema=", ".join(f"`{c}` string" for c in columns))
    return df if keep is None else df.where(keep)


def read_after_preamble(spark: SparkSession, path: str, names: list[str], *, sep: str = ",", encoding: str = "UTF-8", above: int = 1) -> DataFrame:
    """All columns as text from files whose header comes after `above` lines; columns `names`, found in the header by their cleaned names whatever their place, null where it hasn't one.

    Each file has its own header. Lines are those of files read whole, so files are small ones, such as catalogs; quoted fields may
    hold separators and doubled quotes, but no line ends. Blank lines go.
    """
    if encoding.upper() not in ("UTF-8", "UTF8"):
        raw = spark.read.format("binaryFile").load(path).select(F.col("path"), F.decode("content", encoding).alias("text"))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    lines = F.filter(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r?\n"), lambda x: F.trim(x) != "")
    quoted = f'"(?:[^"]|"")*"|[^{re.escape(sep)}]*'
    # every field is followed by a separator
    fields = lambda x: F.transform(F.regexp_extract_all(F.concat(x, F.lit(sep)), F.lit(f"({quoted}){re.escape(sep)}"), F.lit(1)), bare)

    def bare(f: Column) -> Column:
        return F.when(f.rlike('^".*"$'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    rows = raw.select(lines.alias("l")).where(F.size("l") > above)
    clean = lambda f: F.trim(F.regexp_replace(f, r"\s+", " "))
    head = F.transform(fields(F.get("l", F.lit(above))), clean)
    body = rows.select(head.alias("h"), F.explode(F.slice("l", above + 2, 1 << 30)).alias("x")).select("h", fields(F.col("x")).alias("f"))
    place = lambda n: F.array_position("h", n).cast("int")
    return body.select(*(F.nullif(F.when(place(n) > 0, F.get("f", place(n) - 1)), F.lit("")).alias(n) for n in names))


def read_lines_of_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object per line; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON objects: path and content; a file that doesn't parse has null content."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("content"))


def table_of_arrays(payloads: DataFrame, body: str, columns: list[str]) -> DataFrame:
    """Rows of JSON payloads that are arrays of arrays with the names first; asked columns as text, null where a payload hasn't one."""
    rows = payloads.select(F.from_json(body, "array<array<string>>").alias("a")).where("size(a) > 0")
    head = F.get("a", 0)
    place = lambda c: F.array_position(head, c).cast("int")
    out = rows.select(F.struct(*(place(c).alias(f"p{i}") for i, c in enumerate(columns))).alias("p"), F.explode(F.slice("a", 2, 1 << 30)).alias("r"))
    return out.select(*(F.when(F.col(f"p.p{i}") > 0, F.get("r", F.col(f"p.p{i}") - 1)).alias(c) for i, c in enumerate(columns)))


def raster_files(listing: DataFrame) -> DataFrame:
    """Attributes from paths such as .../municipio/group/tile_layer_quality.tif: tile_id, layer, quality, municipio, bg. Others go."""
    parts = F.split("path", "/")
    name = F.regexp_extract("path", r"([^/]+)\.tiff?$", 1)
    pieces = r"^(.+)_([a-z]+)_([A-Z]+)$"
    out = listing.withColumn("__name", name).where(F.col("__name").rlike(pieces))
    part = lambda i: F.regexp_extract("__name", pieces, i)
    return out.withColumns({"tile_id": part(1), "layer": part(2), "quality": part(3), "bg": F.try_element_at(parts, F.lit(-2)), "municipio": F.try_element_at(parts, F.lit(-3))}).drop("__name")


def with_sidecars(rasters: DataFrame, sidecars: DataFrame, columns: list[str], cutoff: str, *, qualities: list[str], layers: list[str] = ("rgb",)) -> DataFrame:
    """raster_files with the columns of each tile's sidecar beside it, imagery_date as date, and item_id, post_cutoff, training_eligible and inference_eligible.

    sidecars: path and content, as `read_sidecars` gives them; that of a tile is `tile_meta.json` in the raster's
    folder. Rasters without one, or with one that doesn't parse, have nulls and aren't eligible; a date that isn't
    one is null. Underscores in a municipio's folder are blanks.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    beside = F.concat(folder(F.col("path")), F.lit("/"), F.col("tile_id"), F.lit("_meta.json"))
    known = sidecars.where("content IS NOT NULL").select(F.col("path").alias("__sidecar"), *(F.col(f"content.{c}").alias(f"__s_{c}") for c in columns)).dropDuplicates(["__sidecar"])
    out = rasters.withColumn("__beside", beside).join(known, F.col("__beside") == F.col("__sidecar"), "left")
    out = out.withColumns({c: F.col(f"__s_{c}") for c in columns}).drop("__beside", "__sidecar", *(f"__s_{c}" for c in columns))
    date = F.try_to_date(F.substring(F.col("imagery_date").cast("string"), 1, 10), "yyyy-MM-dd")
    out = out.withColumns({"imagery_date": date, "municipio": F.replace("municipio", F.lit("_"), F.lit(" ")), "item_id": F.concat_ws("_", "tile_id", "layer", "quality")})
    post = F.coalesce(F.col("imagery_date") >= F.lit(cutoff).cast("date"), F.lit(False))
    shown = F.col("layer").isin(list(layers))
    return out.withColumns({"post_cutoff": post, "training_eligible": post & F.col("quality").isin(qualities) & shown, "inference_eligible": post & shown})


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, modified, bytes of the files below a folder, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def eligible(rasters: DataFrame, cutoff: str, *, qualities: list[str], layers: list[str], gsd_m: float = 1.5, epsg: int = 3857, bands: int = 3) -> DataFrame:
    """rasters with post_cutoff, training_eligible and inference_eligible; a null never qualifies."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    post = yes(F.col("imagery_date") >= F.lit(cutoff).cast("date"))
    fit = yes((F.col("bands") >= bands) & (F.col("gsd_m") <= gsd_m) & (F.col("epsg") == epsg))
    return rasters.withColumns({"post_cutoff": post, "training_eligible": post & yes(F.col("quality").isin(qualities) & F.col("layer").isin(layers)), "inference_eligible": post & fit})


def overlapping_box(df: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose nested bbox meets the area: plain comparisons, which reach the Parquet scan."""
    b = F.col("bbox")
    return df.where((b.xmin <= area[2]) & (b.xmax >= area[0]) & (b.ymin <= area[3]) & (b.ymax >= area[1]))


def write_sorted(df: DataFrame, path: str, by: list[str], partitions: int) -> None:
    """Parquet files that each hold a range of the keys, sorted, so that readers skip files and row groups."""
    df.repartitionByRange(partitions, *by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_ledger(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append rows in the ledger's schema: missing columns as nulls, others left out."""
    have = set(df.columns)
    df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)


def reused_or_built(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> tuple[DataFrame, bool]:
    """The table at a path, built first if it isn't there or is to be refreshed; and whether it was built."""
    if not refresh:
        try:
            return spark.read.parquet(path), False
        except Exception as e:  # Spark's own exception for a path that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), True


def with_envelope(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumns(envelope(F.col(geom)))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def exact_scan(df: DataFrame, area: tuple[float, float, float, float], geometry: Column, geom: str = "geom", order: str = "datetime") -> DataFrame:
    """Rows whose geometry meets the given one, latest first by `order`, nulls last, if there is such a column.

    If the table has a nested `bbox`, rows whose box misses the area's are skipped by plain comparisons, which reach
    the scan; a null box isn't in it.
    """
    near = overlapping_box(df, area) if "bbox" in df.columns else df
    found = near.where(intersects(F.col(geom), geometry))
    return found.orderBy(F.desc_nulls_last(order)) if order in df.columns else found


def write_by_place(df: DataFrame, path: str, x: str, y: str, partitions: int, bits: int = 16) -> None:
    """Parquet files that each hold a range of a Hilbert curve through the points (x, y), sorted along it, so that a box touches few files and row groups.

    The curve lies over the bounds of the table, one row. Rows without a place come first.
    """
    span = df.agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max)))).first()
    if span[0] is None or span[2] is None:
        df.repartition(partitions).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    key = hilbert_key(F.col(x), F.col(y), (span[f"min_{x}"], span[f"min_{y}"], span[f"max_{x}"], span[f"max_{y}"]), bits)
    dealt = df.withColumn("__key", key).repartitionByRange(partitions, "__key").sortWithinPartitions("__key")
    dealt.drop("__key").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, name: str, path: str | None = None, *, nulls: dict[str, str] | None = None) -> DataFrame:
    """Create or replace a table, with those of `nulls` (name: type) that df hasn't as null columns; if asked also Parquet. Returns table and rows, from what was written."""
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in (nulls or {}).items() if c not in df.columns})
    out.write.mode("overwrite").saveAsTable(name)
    saved = df.sparkSession.table(name)
    if path:
        saved.write.mode("overwrite").parquet(path)
    return saved.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header in every part file; nulls are empty, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines_of_json(df: DataFrame, path: str) -> None:
    """A JSON object per line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_report(values: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """One JSON object, with the keys of a small table sorted, as a file of one line. Of repeated keys the least value counts; NaN is null."""
    rows = values.groupBy(key).agg(F.min(value).alias("v"))
    v = F.col("v")
    if dict(rows.dtypes)["v"] in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), v.alias("v")))))
    rows.agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def combined(spark: SparkSession, paths: list[str], dedup: list[str] | None = None) -> DataFrame | None:
    """The union by name of those tables that exist and have rows; None if none has. dedup: keys of which the first path's row stays."""
    parts = []
    for i, p in enumerate(paths):
        try:
            df = spark.read.parquet(p)
        except Exception as e:  # Spark's own exception for a path that isn't there
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if not df.isEmpty():
            parts.append(df.withColumn("__path", F.lit(i)))
    if not parts:
        return None
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if dedup:
        plain = [c for c, t in rows.dtypes if not t.startswith("map")]
        first = F.row_number().over(Window.partitionBy(*dedup).orderBy("__path", *(F.asc_nulls_last(c) for c in plain)))
        rows = rows.withColumn("__n", first).where("__n = 1").drop("__n")
    return rows.drop("__path")


def preview(spark: SparkSession, name: str, rows: int = 5) -> tuple[list[tuple[str, str]], DataFrame]:
    """Columns with types, and a few rows, of a table or view; ValueError if there is none."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name!r}")
    df = spark.table(name)
    return df.dtypes, df.limit(rows)


def tables_of(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """name and kind (table or view) of the tables and temporary views whose name fits a pattern with asterisks, by name."""
    found = [(x.name, "view" if x.isTemporary or x.tableType == "VIEW" else "table") for x in spark.catalog.listTables(pattern=pattern)]
    return spark.createDataFrame(sorted(found), "name string, kind string")


def drop_relation(spark: SparkSession, name: str) -> str:
    """Drop a table or temporary view; returns which it was, or none."""
    if spark.catalog.dropTempView(name):
        return "view"
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE {name}")
        return "table"
    return "none"


def require_tables(spark: SparkSession, names: list[str]) -> None:
    if missing := [n for n in names if not spark.catalog.tableExists(n)]:
        raise ValueError(f"tables missing: {', '.join(missing)}")
