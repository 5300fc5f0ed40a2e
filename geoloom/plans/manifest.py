"""Manifests of work over cells: building, ranking, probing, budgets, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import hex_cell, hex_centre, to_utm
from ..functions.scalars import equal_area_radius, lookup
from ..operators.spatial import dominant_per_cell
from ..operators.tables import first_per, first_values, updated
from ..sources.files import ranges_of, saved

#: Imagery qualities from best to worst.
QUALITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "BASE": 3}


def quality_rank(c: Column) -> Column:
    out = F.lit(len(QUALITY_RANK))
    for name, rank in QUALITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def occupied_cells(buildings: DataFrame, *, lon: str, lat: str, name: str, edge_m: float) -> DataFrame:
    """Hexagon cells with buildings: q, r, dominant name and its count, building_count, crosses_boundary, centre in metres."""
    x, y = to_utm(F.col(lon), F.col(lat))
    q, r = hex_cell(x, y, edge_m)
    out = dominant_per_cell(buildings.select(name, q.alias("q"), r.alias("r")), cell=["q", "r"], name=name)
    cx, cy = hex_centre(F.col("q"), F.col("r"), edge_m)
    return out.withColumns({"centre_x_m": cx, "centre_y_m": cy})


def tile_manifest(cells: DataFrame, points: DataFrame, *, seeds: DataFrame | None, edge_m: float, quality: str) -> DataFrame:
    """Cells as tiles with radius, number of points inside, priority (1; 2 with a point; 3 in a seed area) and status.

    points: x_m, y_m. seeds: boxes minx, miny, maxx, maxy in metres, a few neighbourhoods; any number works.
    """
    q, r = hex_cell(F.col("x_m"), F.col("y_m"), edge_m)
    counts = points.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("points"))
    out = cells.join(counts, ["q", "r"], "left").withColumn("points", F.coalesce("points", F.lit(0)))
    priority = F.when(F.col("points") > 0, 2).otherwise(1)
    if seeds is not None:
        from ..operators.spatial import candidate_pairs

        ids = cells.select(F.struct("q", "r").alias("id"), *(F.col("centre_x_m").alias(c) for c in ("minx", "maxx")), *(F.col("centre_y_m").alias(c) for c in ("miny", "maxy")))
        hit = candidate_pairs(ids, seeds, cell=8 * edge_m).select("l.id.q", "l.id.r").distinct().withColumn("seeded", F.lit(True))
        out = out.join(hit, ["q", "r"], "left")
        priority = F.when(F.col("seeded"), 3).otherwise(priority)
    hexagon = 1.5 * 3**0.5 * edge_m**2
    return out.withColumns(
        {"priority": priority, "radius_m": equal_area_radius(F.lit(hexagon)), "required_quality": F.lit(quality), "status": F.lit("pending"), "tile_id": F.concat_ws("_", F.lit("t"), "q", "r")}
    ).drop("seeded")


def grid_tiles(areas: DataFrame, *, area_id: str, spacing: float, radius: float) -> DataFrame:
    """Tiles at multiples of spacing whose disk meets an area's box; ids count from 0 within an area, by y then x."""
    reach = lambda lo, hi: F.sequence(F.floor((F.col(lo) - radius) / spacing), F.ceil((F.col(hi) + radius) / spacing))
    grid = areas.withColumn("i", F.explode(reach("minx", "maxx"))).withColumn("j", F.explode(reach("miny", "maxy")))
    grid = grid.withColumns({"x": F.col("i") * F.lit(float(spacing)), "y": F.col("j") * F.lit(float(spacing))})
    dx = F.greatest(F.col("minx") - F.col("x"), F.lit(0.0), F.col("x") - F.col("maxx"))
    dy = F.greatest(F.col("miny") - F.col("y"), F.lit(0.0), F.col("y") - F.col("maxy"))
    kept = grid.where(dx * dx + dy * dy <= radius * radius)
    n = F.row_number().over(Window.partitionBy(area_id).orderBy("j", "i")) - 1
    return kept.withColumn("n", n).select(area_id, F.format_string("%s_t%04d", F.col(area_id).cast("string"), F.col("n")).alias("tile_id"), "x", "y")


def collapsed_probe(probe: DataFrame) -> DataFrame:
    """One row per tile: of status, quality and date the first that isn't null, best quality first, then latest date."""
    order = [quality_rank(F.col("quality")), F.desc_nulls_last("imagery_date"), F.asc_nulls_last("status")]
    return first_values(probe, ["tile_id"], order, ["status", "quality", "imagery_date"])


#: Qualities by which a fetch prefers one of several probes of a date; others count 0.
FETCH_RANK = {"MEDIUM": 2, "BASE": 1}


def fetch_candidates(probe: DataFrame, cutoff: str, qualities: list[str]) -> DataFrame:
    """The best usable probe of each tile, ok, of an allowed quality, at or after the cutoff, with fetch_quality.

    The latest counts; of one date that of higher returned and requested quality (FETCH_RANK), priority_score,
    number of panels and of buildings, nulls last. Columns that the table hasn't decide nothing. Among rows that
    are equal in all of these, the least in all columns together counts.
    """
    rows = probe.where((F.col("status") == "ok") & F.col("quality").isin(qualities) & (F.col("imagery_date") >= F.lit(cutoff).cast("date")))
    rank = lambda c: F.desc(lookup(F.col(c), FETCH_RANK, 0))
    order = [F.desc("imagery_date"), *(rank(c) for c in ("quality", "requested_quality") if c in probe.columns)]
    order += [F.desc_nulls_last(c) for c in ("priority_score", "panels", "building_count") if c in probe.columns]
    plain = [c for c, t in probe.dtypes if not t.startswith("map")]
    return first_per(rows, ["tile_id"], [*order, *(F.asc_nulls_last(c) for c in plain)]).withColumn("fetch_quality", F.col("quality"))


def probe_verdict(best: DataFrame, cutoff: str) -> DataFrame:
    """best probes with manifest_status: ready or stale for ok ones at or after, or before the cutoff or without a date; no_coverage for not_found; else probe_failed."""
    recent = F.coalesce(F.col("imagery_date") >= F.lit(cutoff).cast("date"), F.lit(False))
    verdict = F.when((F.col("status") == "ok") & recent, "ready").when(F.col("status") == "ok", "stale").when(F.col("status") == "not_found", "no_coverage")
    return best.withColumn("manifest_status", F.coalesce(verdict, F.lit("probe_failed")))


def probe_summary(probe: DataFrame, cutoff: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tiles by group, status, quality and period (before or after the cutoff, null without a date); and failures by status and code."""
    period = F.when(F.col("imagery_date") >= F.lit(cutoff).cast("date"), "after").when(F.col("imagery_date").isNotNull(), "before")
    tiles = probe.groupBy(*by, "status", "quality", period.alias("period")).agg(F.count("*").alias("tiles"))
    failed = probe.where(F.coalesce(F.col("status") != "ok", F.lit(True))).groupBy("status", "http_status").agg(F.count("*").alias("tiles"))
    return tiles, failed


def manifest_preview(manifest: DataFrame, by: list[str] = ("priority", "municipio", "required_quality")) -> DataFrame:
    """Tiles, points and buildings per group of a manifest, by its columns that are there, in their order."""
    have = [c for c in by if c in manifest.columns]
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("points", "building_count") if c in manifest.columns]
    return manifest.groupBy(*have).agg(F.count("*").alias("tiles"), *total).orderBy(*(F.desc_nulls_last(c) if c == "priority" else F.asc_nulls_last(c) for c in have))


def within_budget(manifest: DataFrame, order: list[str], costs: Column, cap: int, parts: int | None = None) -> DataFrame:
    """Rows in order while the sum of costs before them stays below the cap; costs aren't negative, a null one is 0.

    Rows are dealt into ranges of `order` (a sorted repartition); only the sums of ranges, as many as `parts` or shuffle partitions, are
    put in one order, and running sums are taken inside each range. Rows that are equal in `order` come in the
    order of a hash of all their columns.
    """
    plain = [c for c, t in manifest.dtypes if not t.startswith("map")]
    rows = manifest.withColumn("__cost", F.coalesce(costs.cast("double"), F.lit(0.0))).withColumn("__tie", F.xxhash64(*plain))
    keys = [*order, "__tie"]
    dealt = saved(rows.repartitionByRange(ranges_of(rows, parts), *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    bounds = dealt.groupBy("__part").agg(F.sum("__cost").alias("__sum"))  # ranges are numbered in order
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = bounds.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0.0))).where(F.col("__before") < cap).drop("__sum")
    run = F.coalesce(F.sum("__cost").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = dealt.join(bounds, "__part").withColumn("__run", run + F.col("__before")).where(F.col("__run") < cap)
    return out.drop("__cost", "__tie", "__part", "__before", "__run")


def promoted(manifest: DataFrame, ledger: DataFrame, terminal: list[str] = ("ok", "not_found")) -> DataFrame:
    """manifest with the latest terminal status of its tiles; others keep theirs, so that they are tried again."""
    latest = first_per(ledger.where(F.col("status").isin(list(terminal))), ["tile_id"], [F.desc("ts"), F.asc_nulls_last("status")])
    return updated(manifest, latest.select("tile_id", "status"), ["tile_id"], ["status"])


def spend(calls: Column, *, free: int = 1000, cap: int = 1999, unit: float = 0.075) -> dict[str, Column]:
    """Free calls used and left, billable calls, calls left to the cap and cost, from a number of paid-for calls."""
    billable = F.greatest(calls - free, F.lit(0))
    return {
        "free_used": F.least(calls, F.lit(free)), "free_left": F.greatest(F.lit(free) - calls, F.lit(0)), "billable": billable,
        "left_to_cap": F.greatest(F.lit(cap) - calls, F.lit(0)), "cost_usd": F.round(billable * unit, 3),
    }


def ledger_summary(ledger: DataFrame, by: list[str] = (), endpoint: str = "layers", **terms) -> DataFrame:
    """Calls that count (this endpoint, ok, not from a cache) and what they cost."""
    counts = (F.col("endpoint") == endpoint) & (F.col("status") == "ok") & ~F.coalesce("cache_hit", F.lit(False))
    out = ledger.groupBy(*by).agg(F.count("*").alias("entries"), F.coalesce(F.sum(counts.cast("int")), F.lit(0)).alias("calls"))
    return out.withColumns(spend(F.col("calls"), **terms))


def cache_key(endpoint: Column, lon: Column, lat: Column, radius: Column, view: Column, pixel: Column, quality: Column) -> Column:
    coordinate = lambda c: F.format_string("%.6f", c)
    return F.concat_ws("__", endpoint, coordinate(lon), coordinate(lat), radius.cast("string"), view, pixel.cast("string"), quality)


def uncached(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def fetch_outcomes(targets: DataFrame, landed: DataFrame, on: list[str], epsg: int = 3857) -> DataFrame:
    """Every target with status reused, fetched or error, the error's text, and a projection code."""
    out = targets.join(landed, on, "left")
    status = F.when(F.col("error").isNotNull() | F.col("path").isNull(), "error").when(F.coalesce("existed", F.lit(False)), "reused").otherwise("fetched")
    return out.withColumns({"status": status, "epsg": F.coalesce("epsg", F.lit(epsg))})
