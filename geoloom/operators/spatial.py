"""Spatial joins as equi-joins on grid cells, then an exact test on the pairs that are left.

Tables have an id and minx, miny, maxx, maxy; general polygons also `geom`. Cells come in levels, each twice as
wide as the one below. A shape's own level is that at which it is between two and four cells wide (the lowest, if
it is smaller), so its box covers few cells of it, and these little besides. A pair meets at the higher of the two shapes' own levels, which is part of the key: the
shape of that level is listed there and nowhere else, the other also at each higher level that the other table
has shapes of. (Those levels, at most `levels`, are looked up first.) So small shapes never meet in cells of
large ones, and a pair counts only in the cell of the lower left corner of the boxes' intersection: once,
without removing duplicates. Nothing is sent whole to all executors unless Spark finds it small; partitions of
crowded cells are split by Spark.

A null box, id or geometry joins nothing. Repeated rows join each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def _levelled(df: DataFrame, cell: float, levels: int) -> DataFrame:
    span = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    own = F.ceil(F.log2(F.greatest(span / cell, F.lit(1.0)))) - 2
    return df.where("minx <= maxx AND miny <= maxy").withColumn("__own", F.least(F.lit(levels - 1), F.greatest(F.lit(0), own)).cast("int"))


def _listed(df: DataFrame, struct: str, side: str, cell: float, others: list[int], on: list[str]) -> DataFrame:
    """df as a struct, with the sides, levels and cells it is listed under. Side `l`: the left shape is of the pair's level."""
    least = min(others, default=1 << 30)
    if side == "l":
        mine, above, met = "l", F.filter(F.array(*map(F.lit, others)), lambda x: x > F.col("__own")), F.col("__own") >= least
    else:
        mine, above, met = "r", F.filter(F.array(*map(F.lit, others)), lambda x: x >= F.col("__own")), F.col("__own") > least
    other = "r" if side == "l" else "l"
    entry = lambda role, at: F.struct(F.lit(role).alias("role"), at.cast("int").alias("at"))
    # of two shapes of one level the left one is listed once, under `l`; a shape without smaller ones on the other side isn't listed for them
    entries = F.concat(F.filter(F.array(entry(mine, F.col("__own"))), lambda _: met), F.transform(above, lambda x: entry(other, x)))
    size = lambda: F.pow(F.lit(2.0), F.col("__e.at")) * cell
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size()), F.floor(F.col(hi) / size()))
    columns = [c for c in df.columns if c != "__own"]
    out = df.withColumn("__e", F.explode(entries)).withColumn("__cx", F.explode(cells("minx", "maxx"))).withColumn("__cy", F.explode(cells("miny", "maxy")))
    return out.select(F.struct(*columns).alias(struct), "__e.role", "__e.at", F.col("__cx").alias("cx"), F.col("__cy").alias("cy"), *(F.col(k).alias(f"__on{i}") for i, k in enumerate(on)))


def meetings(left: DataFrame, right: DataFrame, *, cell: float, levels: int = 24, on: list[str] = ()) -> DataFrame:
    """Pairs of rows `l` and `r` that share a cell, and the columns `on`, once per cell, with that cell: role, at, cx, cy."""
    a, b = (_levelled(df, cell, levels) for df in (left, right))
    found = a.select(F.lit("l").alias("s"), "__own").union(b.select(F.lit("r"), "__own")).distinct().collect()  # at most 2 * levels rows
    of = {side: sorted(r["__own"] for r in found if r.s == side) for side in "lr"}
    keys = ["role", "at", "cx", "cy", *(f"__on{i}" for i in range(len(on)))]
    return _listed(a, "l", "l", cell, of["r"], on).join(_listed(b, "r", "r", cell, of["l"], on), keys)


def candidate_pairs(left: DataFrame, right: DataFrame, *, cell: float, levels: int = 24, on: list[str] = ()) -> DataFrame:
    """All pairs whose boxes share a point and whose columns `on` are equal, once each, as structs `l` and `r` of the rows. cell: about the size of the smaller shapes."""
    size = F.pow(F.lit(2.0), F.col("at")) * cell
    corner = lambda lo: F.floor(F.greatest(F.col(f"l.{lo}"), F.col(f"r.{lo}")) / size)
    once = (F.col("cx") == corner("minx")) & (F.col("cy") == corner("miny"))
    return meetings(left, right, cell=cell, levels=levels, on=on).where(once & g.bbox_overlaps("l", "r")).select("l", "r")


def overlap_pairs(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, cell: float, boxes: bool = False, levels: int = 24) -> DataFrame:
    """left_id, right_id, overlap of all pairs that intersect, borders included. boxes: the geometries are their boxes."""
    pairs = candidate_pairs(left, right, cell=cell, levels=levels)
    if not boxes:
        pairs = pairs.where(g.intersects("l.geom", "r.geom"))
    size = g.bbox_overlap_area("l", "r") if boxes else g.overlap_area("l.geom", "r.geom")
    return pairs.select(F.col(f"l.{left_id}").alias(left_id), F.col(f"r.{right_id}").alias(right_id), size.alias("overlap")).where(
        F.col(left_id).isNotNull() & F.col(right_id).isNotNull()
    )


def largest_overlap(left: DataFrame, pairs: DataFrame, *, left_id: str, right_id: str, least_share: Column | None = None) -> DataFrame:
    """left with right_id of its largest overlap, ties to the smaller id; null without one.

    least_share: a condition on `overlap` and left's columns, such as more than half the area.
    """
    best = pairs
    if least_share is not None:
        best = pairs.join(left, left_id).where(least_share).select(left_id, right_id, "overlap")
    best = best.groupBy(left_id).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(right_id).alias("id"))).alias("best"))
    return left.join(best, left_id, "left").withColumn(right_id, F.col("best.id")).drop("best")


def points_within(points: DataFrame, areas: DataFrame, *, point_id: str, area_id: str, x: str, y: str, cell: float, boxes: bool = False) -> DataFrame:
    """point_id, area_id of the areas that hold a point; left and lower borders belong to an area."""
    dots = points.select(F.col(point_id), F.col(x).alias("minx"), F.col(x).alias("maxx"), F.col(y).alias("miny"), F.col(y).alias("maxy"))
    pairs = candidate_pairs(dots, areas, cell=cell)
    px, py = F.col("l.minx"), F.col("l.miny")
    inside = (px < F.col("r.maxx")) & (py < F.col("r.maxy")) if boxes else g.contains_point(F.col("r.geom"), px, py)
    return pairs.where(inside).select(F.col(f"l.{point_id}").alias(point_id), F.col(f"r.{area_id}").alias(area_id))


def assign_two_stage(left: DataFrame, areas: DataFrame, *, left_id: str, area_id: str, x: str, y: str, cell: float, boxes: bool = False) -> DataFrame:
    """left with the area that holds its point, else that of largest overlap; ties to the smaller id."""
    inside = points_within(left, areas, point_id=left_id, area_id=area_id, x=x, y=y, cell=cell, boxes=boxes).groupBy(left_id).agg(F.min(area_id).alias("__point"))
    over = overlap_pairs(left, areas, left_id=left_id, right_id=area_id, cell=cell, boxes=boxes).where("overlap > 0")
    out = largest_overlap(left, over, left_id=left_id, right_id=area_id).join(inside, left_id, "left")
    return out.withColumn(area_id, F.coalesce("__point", area_id)).drop("__point")


def assign_any(left: DataFrame, areas: DataFrame, *, left_id: str, area_id: str, x: str, y: str, cell: float, boxes: bool = False) -> DataFrame:
    """left with the area that holds its point, else any that it meets, borders included; several: the smallest id."""
    inside = points_within(left, areas, point_id=left_id, area_id=area_id, x=x, y=y, cell=cell, boxes=boxes).groupBy(left_id).agg(F.min(area_id).alias("__point"))
    rest = left.join(inside, left_id, "left_anti")
    met = overlap_pairs(rest, areas, left_id=left_id, right_id=area_id, cell=cell, boxes=boxes).groupBy(left_id).agg(F.min(area_id).alias("__met"))
    out = left.join(inside, left_id, "left").join(met, left_id, "left")
    return out.withColumn(area_id, F.coalesce("__point", "__met")).drop("__point", "__met")


def areas_of(shapes: DataFrame, by: list[str], *, to=None, id_column: str | None = None) -> DataFrame:
    """Per group: shapes, their area in the coordinates' units or, with a projection `to`, in those of the projected ones, its mean, and the largest (its id, ties to the smaller)."""
    geom = F.col("geom") if to is None else g.projected(F.col("geom"), to)
    sized = shapes.withColumn("__a", g.area(geom))
    largest = [F.min_by(id_column, F.struct((-F.coalesce("__a", F.lit(-1.0))).alias("a"), F.col(id_column).alias("id"))).alias("largest")] if id_column else []
    return sized.groupBy(*by).agg(F.count("*").alias("shapes"), F.coalesce(F.sum("__a"), F.lit(0.0)).alias("area"), F.avg("__a").alias("mean_area"), *largest)


def flag_intersecting(left: DataFrame, pairs: DataFrame, *, left_id: str, flag: str) -> DataFrame:
    """left with a boolean: it is in one of the pairs."""
    keys = pairs.select(left_id).distinct().withColumn("__hit", F.lit(True))
    return left.join(keys, left_id, "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__hit")


def count_and_area(left: DataFrame, pairs: DataFrame, *, left_id: str, count: str, total: str) -> DataFrame:
    """left with the number of its pairs and the sum of their overlaps, zero without any."""
    sums = pairs.groupBy(left_id).agg(F.count("*").alias("__n"), F.sum("overlap").alias("__s"))
    out = left.join(sums, left_id, "left")
    return out.withColumns({count: F.coalesce("__n", F.lit(0)), total: F.coalesce("__s", F.lit(0.0))}).drop("__n", "__s")


def dominant_per_cell(rows: DataFrame, *, cell: list[str], name: str) -> DataFrame:
    """Per cell: the name with most rows (ties to the smaller), its count, the cell's total, and whether others are there too."""
    counts = rows.groupBy(*cell, name).agg(F.count("*").alias("n"))
    best = counts.groupBy(*cell).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(name).alias("name"))).alias("best"), F.sum("n").alias("building_count"))
    return best.select(*cell, F.col("best.name").alias(name), (-F.col("best.n")).alias("dominant_count"), "building_count").withColumn(
        "crosses_boundary", F.col("building_count") > F.col("dominant_count")
    )


def contiguity(areas: DataFrame, *, area_id: str, digits: int = 7) -> DataFrame:
    """src, dst, w: areas that share a vertex (Queen), weights of a row summing to 1. Vertices are compared at `digits` decimals."""
    corner = F.explode(F.flatten("geom.rings")).alias("p")
    at = areas.select(F.col(area_id).alias("id"), corner).select("id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    edges = at.alias("a").join(at.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.id") != F.col("b.id")))
    edges = edges.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()
    degree = edges.groupBy("src").agg((F.lit(1.0) / F.count("*")).alias("w"))
    return edges.join(degree, "src").select("src", "dst", "w")


def best_per_source(candidates: DataFrame, *, geometry_id: str, preferred: Column, order: list[Column], per_source: str | None = None) -> DataFrame:
    """Candidates in order per geometry; if a geometry has preferred ones, only those; optionally the first of each source."""
    has = F.max(preferred.cast("int")).over(Window.partitionBy(geometry_id))
    kept = candidates.withColumn("__has", has).where((F.col("__has") == 0) | preferred).drop("__has")
    if per_source:
        first = F.row_number().over(Window.partitionBy(geometry_id, per_source).orderBy(*order))
        kept = kept.withColumn("__n", first).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(geometry_id).orderBy(*order)))
