"""Imagery targets and label grids over tables of footprints, areas and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.outlines import covered_area
from ..operators.spatial import candidate_pairs
from ..operators.tables import first_groups, first_per


def chip_bounds(x: Column, y: Column, span: Column) -> dict[str, Column]:
    """The square of this span around a point."""
    half = span / 2
    return {"minx": x - half, "miny": y - half, "maxx": x + half, "maxy": y + half}


def chip_span(size: Column, step: int = 16) -> Column:
    """A size rounded up to a multiple of step."""
    return F.ceil(size / step) * step


def label_grid(chips: DataFrame, polygons: DataFrame, *, chip_id: str, cells: int, cell: float, boxes: bool = False) -> DataFrame:
    """chip_id, row, col of the grid cells of a chip whose centre lies in a polygon; row 0 is the top.

    Only cells within the boxes' intersection are made, and each once however many polygons cover it.
    """
    pairs = candidate_pairs(chips, polygons, cell=cell)
    w, h = ((F.col(f"l.max{a}") - F.col(f"l.min{a}")) / cells for a in "xy")
    inside = lambda a: (F.greatest(F.col(f"l.min{a}"), F.col(f"r.min{a}")), F.least(F.col(f"l.max{a}"), F.col(f"r.max{a}")))
    (x0, x1), (y0, y1) = inside("x"), inside("y")
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(cells - 1)).cast("int")
    cols = F.sequence(clip(F.floor((x0 - F.col("l.minx")) / w)), clip(F.floor((x1 - F.col("l.minx")) / w)))
    rows = F.sequence(clip(F.floor((F.col("l.maxy") - y1) / h)), clip(F.floor((F.col("l.maxy") - y0) / h)))
    made = pairs.withColumn("col", F.explode(cols)).withColumn("row", F.explode(rows))
    x, y = F.col("l.minx") + (F.col("col") + 0.5) * w, F.col("l.maxy") - (F.col("row") + 0.5) * h
    hit = (x >= F.col("r.minx")) & (x < F.col("r.maxx")) & (y >= F.col("r.miny")) & (y < F.col("r.maxy")) if boxes else g.contains_point(F.col("r.geom"), x, y)
    return made.where(hit).select(F.col(f"l.{chip_id}").alias(chip_id), "row", "col").distinct()


def touched_grid(chips: DataFrame, polygons: DataFrame, *, chip_id: str, cells: int, cell: float, held: DataFrame | None = None) -> DataFrame:
    """chip_id, row, col of the grid cells of a chip that a polygon touches: those its edges pass through and those whose centre it holds.

    Every edge is followed row by row: within a row it runs from one x to another, and all columns between are touched.
    A point on a line between cells belongs to the upper, right one; what lies outside of the chip is left out.
    held: the rows of `label_grid`, if they are there already.
    """
    pairs = candidate_pairs(chips, polygons, cell=cell)
    w, h = ((F.col(f"l.max{a}") - F.col(f"l.min{a}")) / cells for a in "xy")
    edges = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(F.get(r, i).alias("p"), F.get(r, i + 1).alias("q")))
    rings = pairs.select("l", F.explode("r.geom.rings").alias("ring")).where("size(ring) > 3")
    # in cells from the lower left corner
    at = lambda k: ((F.col(f"e.{k}.x") - F.col("l.minx")) / w, (F.col(f"e.{k}.y") - F.col("l.miny")) / h)
    (px, py), (qx, qy) = at("p"), at("q")
    lines = rings.select("l", F.explode(edges(F.col("ring"))).alias("e")).select(F.col(f"l.{chip_id}").alias(chip_id), px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"))
    clip = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(cells - 1))
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    lines = lines.where((high >= 0) & (low < cells)).withColumn("j", F.explode(F.sequence(clip(low), clip(high))))
    slope = (F.col("qx") - F.col("px")) / (F.col("qy") - F.col("py"))
    x_at = lambda y: F.when(F.col("py") == F.col("qy"), F.col("px")).otherwise(F.col("px") + slope * (y - F.col("py")))
    a, b = x_at(F.greatest(low, F.col("j").cast("double"))), x_at(F.least(high, F.col("j") + 1.0))
    flat = F.col("py") == F.col("qy")
    left, right = F.when(flat, F.least("px", "qx")).otherwise(F.least(a, b)), F.when(flat, F.greatest("px", "qx")).otherwise(F.greatest(a, b))
    passed = lines.withColumns({"__a": left, "__b": right}).where((F.col("__b") >= 0) & (F.col("__a") < cells))
    passed = passed.withColumn("i", F.explode(F.sequence(clip(F.col("__a")), clip(F.col("__b")))))
    border = passed.select(chip_id, (F.lit(cells - 1) - F.col("j")).cast("int").alias("row"), F.col("i").cast("int").alias("col"))
    held = label_grid(chips, polygons, chip_id=chip_id, cells=cells, cell=cell) if held is None else held
    return border.union(held.select(chip_id, "row", "col")).distinct()


def chip_labels(chips: DataFrame, polygons: DataFrame, *, chip_id: str, polygon_id: str, cells: int, cell: float, boxes: bool = False) -> DataFrame:
    """Per chip with a label: polygons that meet it, and labelled cells; chips without a labelled cell are left out."""
    n = candidate_pairs(chips, polygons, cell=cell).groupBy(F.col(f"l.{chip_id}").alias(chip_id)).agg(F.countDistinct(f"r.{polygon_id}").alias("polygons"))
    grid = label_grid(chips, polygons, chip_id=chip_id, cells=cells, cell=cell, boxes=boxes).groupBy(chip_id).agg(F.count("*").alias("labelled_cells"))
    return n.join(grid, chip_id)


def fetch_targets(footprints: DataFrame, cells: DataFrame, *, item_id: str, cell_id: str, cell: float, order: list[Column], most_items: int | None = None, asset_group: list[str] = (), most_assets: int | None = None) -> DataFrame:
    """item_id, cell_id for each occupied cell's footprints, once each. Caps count items, and groups of rows with equal columns `asset_group`, not rows; both take the first in order."""
    pairs = candidate_pairs(footprints, cells, cell=cell)
    rows = pairs.select(F.col("l.*"), F.col(f"r.{cell_id}").alias(cell_id)).dropDuplicates([item_id, cell_id])
    if most_items is not None:
        top = footprints.join(rows.select(item_id).distinct(), item_id, "left_semi").orderBy(*order).limit(most_items).select(item_id)
        rows = rows.join(top, item_id, "left_semi")
    if most_assets is not None:
        rows = first_groups(rows, list(asset_group) or [item_id], order, most_assets)
    return rows.select(item_id, cell_id)


def area_coverage(areas: DataFrame, footprints: DataFrame, *, area_id: str, item_id: str, source: str, cell: float, boxes: bool = False) -> DataFrame:
    """Per area: items that meet it, their sources by name, and the area that they cover of it, each spot once. boxes: all shapes are their boxes."""
    pairs = candidate_pairs(areas, footprints, cell=cell)
    if not boxes:
        pairs = pairs.where(g.intersects("l.geom", "r.geom"))
    items = pairs.groupBy(F.col(f"l.{area_id}").alias(area_id)).agg(F.countDistinct(f"r.{item_id}").alias("items"), F.array_join(F.array_sort(F.collect_set(f"r.{source}")), ", ").alias("sources"))
    out = areas.select(area_id).join(items, area_id, "left").join(covered_area(areas, footprints, area_id=area_id, cell=cell, boxes=boxes), area_id, "left")
    return out.select(area_id, F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def year_pivot(rows: DataFrame, by: str, date: str, years: list[int]) -> DataFrame:
    """Counts of a group by year (those given), zero where there are none, with the total and its percent of all."""
    wide = rows.withColumn("__year", F.year(date)).groupBy(by).pivot("__year", years).count().na.fill(0)
    total = sum((F.col(str(y)) for y in years[1:]), F.col(str(years[0])))
    wide = wide.withColumn("total", total)
    every = wide.agg(F.sum("total").alias("__every"))  # one row
    return wide.join(F.broadcast(every)).withColumn("pct", F.round(F.col("total") * 100.0 / F.col("__every"), 3)).drop("__every")


def scorecard(areas: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """areas with the columns of each part (one row per key), numbers filled with zero."""
    out = areas
    for p in parts:
        out = out.join(p, key, "left")
    numbers = [f.name for p in parts for f in p.schema if f.name != key and f.dataType.typeName() in ("long", "integer", "double")]
    return out.na.fill(0, numbers)


def example_page(candidates: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of candidates in order."""
    return candidates.orderBy(*order).offset(offset).limit(limit)


def missing_and_median(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """by, metric, median, missing: a row per group and metric."""
    entries = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return rows.select(by, entries.alias("e")).groupBy(by, "e.metric").agg(F.median("e.value").alias("median"), F.sum(F.col("e.value").isNull().cast("int")).alias("missing"))


def share_flagged(levels: dict[str, DataFrame], flag: str) -> DataFrame:
    """Per level: rows, flagged rows and their percent."""
    out = None
    for name, df in levels.items():
        n = F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))
        part = df.agg(F.lit(name).alias("level"), F.count("*").alias("rows"), n.alias("flagged"), F.round(F.try_divide(n * 100.0, F.nullif(F.count("*"), F.lit(0))), 3).alias("pct"))
        out = part if out is None else out.unionByName(part)
    return out


def best_footprint(footprints: DataFrame, areas: DataFrame, *, area_id: str, order: list[Column], cell: float) -> DataFrame:
    """The first footprint of each area in order; columns of footprints and area_id."""
    pairs = candidate_pairs(footprints, areas, cell=cell).select("l.*", F.col(f"r.{area_id}").alias(area_id))
    return first_per(pairs, [area_id], order)
