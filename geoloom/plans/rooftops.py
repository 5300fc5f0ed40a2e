"""Buildings, panels and detections: flags, summaries, candidate choice, and what is kept of detections and rasters.

Nulls: a null flag, count or area is false or 0 in sums; null groups are groups of their own. Ties are broken by
the keys named. Empty tables give empty results, and global summaries one row of zeros and nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import envelope, intersects
from ..functions.scalars import elevation, text_or_empty
from ..operators.spatial import candidate_pairs
from ..operators.statistics import flagged, weighted_mean
from ..operators.tables import first_per


def pv_flags(buildings: DataFrame, mapped: DataFrame, detected: DataFrame, *, key: str = "building_id") -> DataFrame:
    """buildings with has_pv_mapped, has_pv_detected, detected_count and detected_area.

    mapped and detected: pairs (key, overlap) of buildings with panels of either source.
    """
    some = mapped.select(key).distinct().withColumn("__m", F.lit(True))
    found = detected.groupBy(key).agg(F.count("*").alias("__n"), F.sum("overlap").alias("__a"))
    n = F.coalesce("__n", F.lit(0))
    out = buildings.join(found, key, "left").join(some, key, "left")
    return out.withColumns(
        {"has_pv_mapped": F.coalesce("__m", F.lit(False)), "has_pv_detected": n > 0, "detected_count": n, "detected_area": F.coalesce("__a", F.lit(0.0))}
    ).drop("__m", "__n", "__a")


def flag_summary(flags: DataFrame, by: list[str], flux: str | None = None, pixels: str | None = None) -> DataFrame:
    """Per group: buildings, mapped, detected and both, area, rate of detection, and the pixel-weighted mean of flux, null without pixels."""
    both = (F.col("has_pv_mapped") & F.col("has_pv_detected")).cast("int")
    extra = [weighted_mean(flux, pixels).alias("flux_mean"), F.sum(F.coalesce(pixels, F.lit(0))).alias("flux_pixels")] if flux else []
    out = flags.groupBy(*by).agg(
        F.count("*").alias("buildings"), flagged("has_pv_mapped").alias("mapped"), flagged("has_pv_detected").alias("detected"), F.coalesce(F.sum(both), F.lit(0)).alias("both"),
        F.sum("detected_area").alias("area"), *extra,
    )
    return out.withColumn("rate", F.when(F.col("buildings") > 0, F.col("detected") / F.col("buildings")).otherwise(0.0))


def detections_kept(detections: DataFrame, area: str, long_side: str, short_side: str, *, least: float = 3.0, most: float = 500.0, elongation: float = 10.0) -> DataFrame:
    """Detections of an area between bounds, included, whose sides' ratio is below a limit; a null or zero side never is."""
    ratio = F.try_divide(F.col(long_side), F.nullif(F.col(short_side), F.lit(0)))
    return detections.where(F.col(area).between(least, most) & (ratio < elongation))


def cascaded(rasters: DataFrame, *, municipio: str | None = None, layers: tuple[str, ...] = ("rgb", "visual"), paths: list[str] = ("path",), existing: DataFrame | None = None) -> DataFrame:
    """Rasters that pass those filters whose columns exist, one row per path.

    municipio; inference_eligible, or without that column training_eligible; layer. The path is the first of
    `paths` that is filled and, if files are given (path), among them. Of equal paths the row that is least in
    all columns stays.
    """
    rows, have = rasters, set(rasters.columns)
    if municipio is not None and "municipio" in have:
        rows = rows.where(F.lower("municipio") == municipio.lower())
    for flag in ("inference_eligible", "training_eligible"):
        if flag in have:
            rows = rows.where(F.coalesce(flag, F.lit(False)))
            break
    if "layer" in have:
        rows = rows.where(F.lower("layer").isin(list(layers)))
    columns = rows.columns
    used = [p for p in paths if p in have]
    listed = F.array(*(F.struct(F.lit(i).alias("step"), F.col(p).alias("path")) for i, p in enumerate(used)))
    rows = rows.withColumn("__row", F.xxhash64(*columns)).withColumn("__p", F.explode(listed)).where(F.coalesce(F.trim("__p.path"), F.lit("")) != "")
    rows = rows.withColumn("__path", F.col("__p.path"))
    if existing is not None:
        rows = rows.join(existing.select(F.col("path").alias("__path")).distinct(), "__path", "left_semi")
    first = first_per(rows, columns, [F.asc("__p.step")])
    order = [F.asc_nulls_last(c) for c in columns]
    return first_per(first, ["__path"], order).withColumn("found_path", F.col("__path")).drop("__p", "__path", "__row")


def training_cells(cells: DataFrame, *, municipios: list[str], least_priority: int, per_group: int, most: int, group: str = "municipio", key: str = "tile_id") -> DataFrame:
    """Cells with panels in these municipalities from a priority on, most panels first, at most per_group of each and `most` in all."""
    order = [F.desc("priority"), F.desc("panels"), F.desc_nulls_last("building_count"), F.asc(key)]
    rows = cells.where(F.col(group).isin(municipios) & (F.col("panels") > 0) & (F.col("priority") >= least_priority))
    return first_per(rows, [group], order, per_group).orderBy(*order).limit(most)


def by_status(manifest: DataFrame, ready_only: bool = True, key: str = "tile_id") -> DataFrame:
    """Rows of a manifest, ready ones or all, in order of priority, highest first."""
    rows = manifest.where(F.col("manifest_status") == "ready") if ready_only else manifest
    return rows.orderBy(F.desc_nulls_last("priority"), key)


def with_candidates(manifest: DataFrame, candidates: DataFrame, columns: list[str], key: str = "tile_id") -> DataFrame:
    """The manifest's rows that have a candidate (one row per tile), with the candidate's columns in place of their own."""
    return manifest.drop(*columns).join(candidates.select(key, *columns), key)


def ranked_counts(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k values with most rows, ties by name, with n and rank; null isn't a value."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), by)))  # k rows


def chosen(rows: DataFrame, name: str, order: list[Column], wanted: str | None) -> DataFrame:
    """The row of the wanted name, whatever its case, or without one the first in order."""
    hit = F.lower(name) == F.lit(wanted.strip().lower() if wanted else None).cast("string")
    return rows.orderBy(F.desc(F.coalesce(hit, F.lit(False))), *order).limit(1)


def candidate_buildings(buildings: DataFrame, panels: DataFrame, *, cell: float, overlap: Column, area: str, top: int | None, building_id: str = "building_id", panel_id: str = "panel_id") -> DataFrame:
    """Buildings that panels meet, of the `top` areas with most panels (or all): panels (distinct) and overlap. overlap: of structs l and r."""
    pairs = candidate_pairs(buildings, panels, cell=cell).select(F.col(f"l.{building_id}").alias(building_id), F.col(f"l.{area}").alias(area), F.col(f"r.{panel_id}").alias("__p"), overlap.alias("__o"))
    if top is not None:
        best = pairs.where(F.col(area).isNotNull()).groupBy(area).agg(F.countDistinct("__p").alias("__n")).orderBy(F.desc("__n"), area).limit(top)
        pairs = pairs.join(best, area, "left_semi")
    return pairs.groupBy(building_id, area).agg(F.countDistinct("__p").alias("panels"), F.sum("__o").alias("overlap"))


def points_in_disks(tiles: DataFrame, points: DataFrame, *, tile_id: str, point_id: str, x: str, y: str, cell: float) -> DataFrame:
    """tile_id, point_id of points at most `radius` from a tile's centre (columns x, y, radius of tiles), border included; disks may overlap."""
    box = tiles.select(F.col(tile_id), F.col("x").alias("cx0"), F.col("y").alias("cy0"), "radius", (F.col("x") - F.col("radius")).alias("minx"), (F.col("y") - F.col("radius")).alias("miny"), (F.col("x") + F.col("radius")).alias("maxx"), (F.col("y") + F.col("radius")).alias("maxy"))
    dots = points.select(F.col(point_id), *(F.col(x).alias(c) for c in ("minx", "maxx")), *(F.col(y).alias(c) for c in ("miny", "maxy")))
    dx, dy = F.col("l.minx") - F.col("r.cx0"), F.col("l.miny") - F.col("r.cy0")
    pairs = candidate_pairs(dots, box, cell=cell).where(dx * dx + dy * dy <= F.col("r.radius") * F.col("r.radius"))
    return pairs.select(F.col(f"r.{tile_id}").alias(tile_id), F.col(f"l.{point_id}").alias(point_id))


def meeting_any(rows: DataFrame, footprints: DataFrame, *, key: str, cell: float, test: Column | None = None) -> DataFrame:
    """Rows that meet at least one footprint: their boxes, and `test` on structs l and r."""
    pairs = candidate_pairs(rows, footprints, cell=cell)
    hit = (pairs if test is None else pairs.where(test)).select(F.col(f"l.{key}").alias(key)).distinct()
    return rows.join(hit, key, "left_semi")


def feature_summary(features: DataFrame, by: list[str], area: Column, key: str) -> DataFrame:
    """Per group: rows, distinct keys, total and mean area, and the key of largest area (ties to the smaller)."""
    best = F.min(F.when(area.isNotNull(), F.struct((-area).alias("a"), F.col(key).alias("k"))))
    return features.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.sum(area).alias("area"), F.avg(area).alias("mean_area"), best["k"].alias("largest"))


def above(rows: DataFrame, ratio: str, limit: float, key: str, n: int) -> DataFrame:
    """The n rows whose ratio exceeds a limit by most."""
    return rows.where(F.col(ratio) > limit).orderBy(F.desc(ratio), key).limit(n)


def cutoff_counts(rows: DataFrame, date: str, cutoff: str, by: list[str] = ()) -> DataFrame:
    """Per group: dates before the cutoff, at or after it, and none; earliest and latest."""
    after = F.col(date) >= F.lit(cutoff).cast("timestamp")
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*by).agg(count(~after).alias("before"), count(after).alias("after"), count(F.col(date).isNull()).alias("none"), F.min(date).alias("earliest"), F.max(date).alias("latest"))


def completeness(rows: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Per group: rows, and of each column the values that aren't null."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count(c).alias(f"with_{c}") for c in columns))


def least_known(*columns: Column, otherwise: float = -1.0) -> Column:
    """The least of the columns that aren't null."""
    return F.coalesce(F.least(*columns), F.lit(otherwise))


def computed_if_missing(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """df with those of the metrics that it has no column of."""
    return df.withColumns({n: c for n, c in metrics.items() if n not in df.columns})


def pv_counts(areas: DataFrame, *, area_id: str, name: str, clean: DataFrame | None = None, stage: DataFrame | None = None, flag: str = "has_pv", cell: float = 0.02) -> tuple[DataFrame, str]:
    """Per area (area_id, name) the number of panels, most first, and which source it comes from.

    clean: panels with their area; only areas with panels are listed. Else stage: raw shapes with geom and tags, of
    which the photovoltaic ones that meet an area count. Else the areas' own flag, as 0 or 1.
    """
    if clean is not None:
        out, source = clean.groupBy(area_id, name).agg(F.count("*").alias("panels")), "clean"
    elif stage is not None:
        tag = lambda c: text_or_empty(stage.columns, c)
        solar = (tag("generator:method") == "photovoltaic") | (tag("generator:source") == "solar") | (tag("generator:type") == "solar_photovoltaic_panel")
        cold = ~tag("content").isin("hot_water", "hot", "water") & (tag("generator:output:hot_water") != "yes")
        shapes = stage.where(solar & cold).select("geom").withColumns(envelope(F.col("geom")))
        pairs = candidate_pairs(areas, shapes, cell=cell).where(intersects("l.geom", "r.geom"))
        n = pairs.groupBy(F.col(f"l.{area_id}").alias(area_id)).agg(F.count("*").alias("panels"))
        out, source = areas.select(area_id, name).join(n, area_id, "left").withColumn("panels", F.coalesce("panels", F.lit(0))), "stage"
    else:
        out, source = areas.select(area_id, name, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).cast("long").alias("panels")), "flag"
    return out.orderBy(F.desc("panels"), name), source


def preview_subset(buildings: DataFrame, group: str, value: str, limit: int, clip: Column | None = None, key: str = "building_id") -> DataFrame:
    """Up to limit buildings of a group: those that meet a clip geometry, by key; without one, or if none does, the tallest, a null height being 0."""
    own = buildings.where(F.col(group) == value)
    if clip is not None:
        near = own.where(intersects(F.col("geom"), clip)).orderBy(key).limit(limit)
        if not near.isEmpty():
            return near
    return own.orderBy(F.desc(F.coalesce(F.col("height"), F.lit(0.0))), key).limit(limit)


def preview_heights(buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """buildings with elevation and where it comes from (height, floors or default), and one row of counts of these."""
    origin = F.when(F.col("height").isNotNull(), "height").when(F.col("floors").isNotNull(), "floors").otherwise("default")
    out = buildings.withColumns({"elevation": elevation(F.col("height"), F.col("floors")), "elevation_from": origin})
    n = lambda k: F.coalesce(F.sum((F.col("elevation_from") == k).cast("long")), F.lit(0)).alias(f"from_{k}")
    return out, out.agg(F.count("*").alias("rows"), *(n(k) for k in ("height", "floors", "default")))
