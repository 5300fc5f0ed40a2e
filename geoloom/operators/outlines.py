"""Outlines made from outlines: growing and shrinking, rows of panels joined to arrays, clipping to windows, covered area.

Growing by d adds to a polygon a strip of width d along each edge and, at outward corners, what lies between two
strips, up to a mitre. Shrinking takes away such strips on the inside. Strips are polygons like any other, so
`overlay` does the rest and nothing is lost where outlines meet, split or vanish. Distances are in units of the coordinates, so these
should be metres.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.arrangement import numbered
from ..functions.arrangement import spread as spread_pairs
from ..sources.files import ranges_of, saved
from .graphs import groups_of, least_linked
from .overlay import PER_TASK, boundary, boundary_area, chained, overlay
from .spatial import candidate_pairs

#: Fixed value: corners that reach further than this, in widths, are cut off straight.
MITRE = 5.0

#: Fixed value: how often an area's box is quartered at most where many footprints end.
QUARTERED = 12
#: Boxes are linked in tiles so many cells wide, of so many boxes at most.
TILE = 64
PER_TILE = 4096

_TILE = ["tx0", "ty0", "tx1", "ty1"]


def once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strips(geom: Column, width: Column, inward: bool = False) -> Column:
    """Array of rings: along each edge a strip, and at each corner that opens to that side the piece between two strips."""
    way = -1 if inward else 1

    def of_ring(ring: Column) -> Column:
        n = F.size(ring) - 1
        ring_of = lambda *p: F.array(*p, p[0])

        def at(i: Column) -> Column:
            p, q, r = F.get(ring, i), F.get(ring, i + 1), F.get(ring, (i + 1) % n + 1)
            (ax, ay), (bx, by) = (q.x - p.x, q.y - p.y), (r.x - q.x, r.y - q.y)
            a, b = F.hypot(ax, ay), F.hypot(bx, by)
            # unit normals to the wanted side
            return F.struct(p.alias("p"), q.alias("q"), (ay / a * way).alias("mx"), (-ax / a * way).alias("my"), (by / b * way).alias("nx"), (-bx / b * way).alias("ny"), (ax * by - ay * bx).alias("turn"), (a * b).alias("size"))

        def pieces(e: Column) -> Column:
            off = lambda v, x, y: g.point_struct(v.x + x * width, v.y + y * width)
            p1, q1, q2 = off(e.p, e.mx, e.my), off(e.q, e.mx, e.my), off(e.q, e.nx, e.ny)
            strip = ring_of(e.p, e.q, q1, p1) if inward else ring_of(e.p, p1, q1, e.q)
            cos = e.mx * e.nx + e.my * e.ny
            tip = off(e.q, (e.mx + e.nx) / (cos + 1), (e.my + e.ny) / (cos + 1))
            sharp = 2 / (cos + 1) > MITRE**2
            corner = F.when(sharp, ring_of(e.q, q2, q1) if inward else ring_of(e.q, q1, q2)).otherwise(ring_of(e.q, q2, tip, q1) if inward else ring_of(e.q, q1, tip, q2))
            opens = e.turn * way > e["size"] * 1e-9
            return F.when(opens, F.array(strip, corner)).otherwise(F.array(strip))

        edges = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i) != F.get(ring, i + 1))
        return F.flatten(F.transform(edges, lambda i: once(at(i), pieces)))

    return F.flatten(F.transform(F.filter(geom["rings"], lambda r: F.size(r) > 3), of_ring))


def offset(geom: Column, width: Column) -> Column:
    """The outline of a convex polygon moved out by width, as one ring; null for other polygons."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring) - 1
        step = lambda i: once(F.array(F.get(ring, i), F.get(ring, i + 1), F.get(ring, (i + 1) % n + 1)), turned)

        def turned(v: Column) -> Column:
            p, q, r = v[0], v[1], v[2]
            (ax, ay), (bx, by) = (q.x - p.x, q.y - p.y), (r.x - q.x, r.y - q.y)
            a, b = F.hypot(ax, ay), F.hypot(bx, by)
            return F.struct(q.alias("q"), (ay / a).alias("mx"), (-ax / a).alias("my"), (by / b).alias("nx"), (-bx / b).alias("ny"), (ax * by - ay * bx).alias("turn"))

        def corner(e: Column) -> Column:
            off = lambda x, y: g.point_struct(e.q.x + x * width, e.q.y + y * width)
            cos = e.mx * e.nx + e.my * e.ny
            return F.when(2 / (cos + 1) > MITRE**2, F.array(off(e.mx, e.my), off(e.nx, e.ny))).otherwise(F.array(off((e.mx + e.nx) / (cos + 1), (e.my + e.ny) / (cos + 1))))

        corners = F.transform(F.sequence(F.lit(0), n - 1), step)
        convex = lambda c: F.forall(c, lambda e: F.coalesce(e.turn > 0, F.lit(False)))
        closed = lambda c: once(F.flatten(F.transform(c, corner)), lambda z: F.concat(z, F.slice(z, 1, 1)))
        return once(corners, lambda c: F.when(convex(c), closed(c)))

    # turning left at every vertex, and once around: the corners' turns sum up to one circle for a simple ring
    return F.when((F.size(geom["rings"]) == 1) & (F.size(F.get(geom["rings"], F.lit(0))) > 3), once(F.get(geom["rings"], F.lit(0)), of_ring))


def _as_polygons(rings: DataFrame, by: list[str]) -> DataFrame:
    return rings.select(*by, F.struct(F.array("__r").alias("rings"), F.col("__srid").alias("srid")).alias("geom"))


def _strips_of(polygons: DataFrame, by: list[str], width: float, inward: bool) -> DataFrame:
    rings = F.explode(strips(F.col("geom"), F.lit(float(width)), inward))
    return _as_polygons(polygons.select(*by, F.col("geom.srid").alias("__srid"), rings.alias("__r")), by)


def _pieces(geom: Column, width: float) -> Column:
    """Array of polygons whose union is what grows: of a convex one its moved outline, of others itself and its strips."""
    w = F.lit(float(width))
    polygon = lambda ring: F.struct(F.array(ring).alias("rings"), geom["srid"].alias("srid"))
    return once(offset(geom, w), lambda r: F.when(r.isNotNull(), F.array(polygon(r))).otherwise(F.concat(F.array(geom), F.transform(strips(geom, w), polygon))))


def _grown_pieces(polygons: DataFrame, by: list[str], width: float) -> DataFrame:
    return polygons.select(*by, F.explode(_pieces(F.col("geom"), width)).alias("geom"))


def grown(polygons: DataFrame, by: list[str], width: float, *, cell: float, digits: int = 6, srid: int = 3857) -> DataFrame:
    """by, geom: the union of each group's polygons with all that is nearer than width, corners mitred; a negative width shrinks it."""
    if width < 0:
        return overlay(polygons, by, cell=cell, other=_strips_of(polygons, by, -width, True), result="difference", digits=digits, srid=srid)
    rows = polygons.select(*by, "geom")
    return overlay(_grown_pieces(rows, by, width) if width else rows, by, cell=cell, digits=digits, srid=srid)


def boxed(polygons: DataFrame) -> DataFrame:
    return polygons.withColumns(g.envelope(F.col("geom")))


def _in_tiles(table: pa.Table, side: float) -> pa.Table:
    """Rows (id, tx, ty, box, many, home) with `name`: the least id that a box is linked to within its tile, by boxes that meet."""
    ids = table.column("id").combine_chunks()
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, tile = numbered(table, ["tx", "ty"])
    x0, y0, x1, y1 = (table.column(c).to_numpy() for c in ("minx", "miny", "maxx", "maxy"))
    # boxes of a tile in order of their left sides; a box's partners are those that begin before it ends
    base = tile * 4.0 * side - table.column("tx").to_numpy() * side
    by_start = np.argsort(base + x0, kind="stable")
    stop = np.searchsorted((base + x0)[by_start], (base + x1)[by_start] + 1e-6 * side, "right")
    n = stop - np.arange(len(stop)) - 1
    name = np.arange(len(order))
    for i, j in spread_pairs(n, np.arange(len(n)) + 1):
        i, j = by_start[i], by_start[j]
        met = (tile[i] == tile[j]) & (x0[i] <= x1[j]) & (x0[j] <= x1[i]) & (y0[i] <= y1[j]) & (y0[j] <= y1[i])
        name = least_linked(name, rank[i[met]], rank[j[met]])
    return pa.table([ids, ids.take(pa.array(order[name[rank]])), table.column("many"), table.column("home")], ["id", "name", "many", "home"])


def linked_boxes(boxes: DataFrame, side: float) -> DataFrame:
    """id, group: the least id among all boxes that a box is linked to by boxes that meet, directly or not. boxes: id, not repeated, and minx, miny, maxx, maxy.

    Boxes are dealt by square tiles, and links within a tile are followed in one task, so that only those boxes that reach
    into several tiles are links between tasks. Boxes wider than a tile, and those of tiles with more than
    `PER_TILE`, are paired by `candidate_pairs`.
    """
    span = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    fits = F.coalesce((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")) & (span <= side), F.lit(False))
    at = lambda c: F.floor(F.col(c) / side)
    many = (at("minx") < at("maxx")) | (at("miny") < at("maxy"))
    tiled = boxes.where(fits).withColumn("many", many).withColumn("tx", F.explode(F.sequence(at("minx"), at("maxx")))).withColumn("ty", F.explode(F.sequence(at("miny"), at("maxy"))))
    tiled = tiled.withColumn("home", (F.col("tx") == at("minx")) & (F.col("ty") == at("miny")))
    crowded = saved(tiled.groupBy("tx", "ty").agg(F.count("*").alias("n")).where(F.col("n") > PER_TILE).select("tx", "ty"), "crowded")
    wide = boxes.where(~fits)
    some_crowded, some_wide = not crowded.isEmpty(), not wide.isEmpty()
    kind = dict(boxes.dtypes)["id"]
    bucket = F.pmod(F.xxhash64("tx", "ty"), F.lit(16 * ranges_of(boxes, None)))
    few = tiled.join(crowded, ["tx", "ty"], "left_anti") if some_crowded else tiled
    few = few.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda t: _in_tiles(t, side), f"id {kind}, name {kind}, many boolean, home boolean")
    few = saved(few, "tiles")
    own = few.where("home").select("id", "name")
    links = few.where("many" if not (some_crowded or some_wide) else "true").select(F.col("id").alias("a"), F.col("name").alias("b"))
    pair = lambda left, right: candidate_pairs(left, right, cell=side / TILE).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).where("a <> b")
    if some_crowded:
        full = tiled.join(crowded, ["tx", "ty"], "left_semi")
        own = own.unionByName(full.where("home").select("id", F.col("id").alias("name")))
        full = saved(full.select(boxes.columns).distinct(), "full")
        links = links.unionByName(pair(full, full))
    if some_wide:
        own = own.unionByName(wide.select("id", F.col("id").alias("name")))
        links = links.unionByName(pair(wide, boxes))
    named = groups_of(links)
    return own.join(named, F.col("name") == F.col("node"), "left").select("id", F.coalesce("group", "name").alias("group"))


def panel_arrays(
    panels: DataFrame, *, panel_id: str, cell: float, bridge: float = 0.9, shrink: float = 0.35, expand: float = 0.10, least_area: float = 8.0, digits: int = 6
) -> tuple[DataFrame, DataFrame]:
    """Arrays of panel rows, (array_id, geom, area, rank), largest first, and which panel is in which group (panel_id, array_group).

    Panels are grown by `bridge`, so that gaps of up to twice that close, united, shrunk, and grown a little again;
    what shrinks to nothing stays as it was; parts under `least_area` go. Panels whose grown outlines may meet form groups, see
    `linked_boxes`, and each group is worked on by itself. An array's id is that of its group, the least
    panel in it, and the number of its part. Copies of a panel are one shape. Outlines keep all corners.
    """
    rows = panels.select(F.col(panel_id).alias("id"), "geom").where(F.col("id").isNotNull() & (F.size("geom.rings") > 0))
    outline = F.struct(F.flatten(F.transform(_pieces(F.col("geom"), bridge), lambda p: p.rings)).alias("rings"), F.col("geom.srid").alias("srid"))
    reach = boxed(rows.select("id", outline.alias("geom"))).groupBy("id").agg(*(f(c).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))))
    member = saved(linked_boxes(saved(reach, "reach"), TILE * cell).withColumnRenamed("group", "g"), "members")
    merged = saved(grown(rows.join(member, "id").select("g", "geom"), ["g"], bridge, cell=cell, digits=digits), "merged")
    less = grown(merged, ["g"], -shrink, cell=cell, digits=digits) if shrink else merged
    less = saved(less, "less")
    kept = less.unionByName(merged.join(less.select("g"), "g", "left_anti"))
    more = boundary(_grown_pieces(kept, ["g"], expand) if expand else kept, ["g"], cell=cell, digits=digits)
    parts = chained(more, ["g"], srid=3857, digits=digits, parts=True).withColumn("area", g.area(F.col("geom"))).where(F.col("area") >= least_area)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("area"), "part"))
    arrays = parts.withColumn("rank", rank).select(F.concat_ws("_", F.col("g").cast("string"), F.col("part").cast("string")).alias("array_id"), F.col("g").alias("array_group"), "geom", "area", "rank")
    return arrays, member.select(F.col("id").alias(panel_id), F.col("g").alias("array_group"))


def clipped(geom: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The geometry within a window, side by side cut off; concave rings may run along the window's border. Without rings if nothing is left."""

    def cut(ring: Column, inside, cross) -> Column:
        def at(i: Column) -> Column:
            p, q = F.get(ring, i), F.get(ring, i + 1)
            met = F.when(inside(p) != inside(q), F.array(cross(p, q))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            return F.when(inside(p), F.concat(F.array(p), met)).otherwise(met)

        left = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.size(ring) > 3), at))
        return once(left, lambda s: F.when(F.size(s) > 2, F.concat(s, F.slice(s, 1, 1))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))

    def on_x(x: Column):
        return lambda p, q: g.point_struct(x, p.y + (q.y - p.y) * (x - p.x) / (q.x - p.x))

    def on_y(y: Column):
        return lambda p, q: g.point_struct(p.x + (q.x - p.x) * (y - p.y) / (q.y - p.y), y)

    sides = [(lambda p: p.x >= minx, on_x(minx)), (lambda p: p.x <= maxx, on_x(maxx)), (lambda p: p.y >= miny, on_y(miny)), (lambda p: p.y <= maxy, on_y(maxy))]
    rings = geom["rings"]
    for inside, cross in sides:
        rings = _each(rings, inside, cross, cut)
    return F.when(geom["rings"].isNotNull(), F.struct(F.filter(rings, lambda r: F.size(r) > 3).alias("rings"), geom["srid"].alias("srid")))


def _each(rings: Column, inside, cross, cut) -> Column:
    return F.transform(rings, lambda r: once(r, lambda own: cut(own, inside, cross)))


def clip_metrics(windows: DataFrame, panels: DataFrame, arrays: DataFrame, buildings: DataFrame, *, window_id: str, cell: float) -> DataFrame:
    """Per window: number and area of panels, arrays and buildings clipped to it, arrays by panels, and percent of the buildings' area that panels have.

    windows: boxes minx, miny, maxx, maxy; the others have geom. Shapes that only touch a window don't count. Ratios
    are null over nothing. Windows without shapes have zeros.
    """
    out = windows.select(window_id)
    for name, df in (("panel", panels), ("array", arrays), ("building", buildings)):
        pairs = candidate_pairs(windows, boxed(df.select("geom")), cell=cell)
        size = g.area(clipped(F.col("r.geom"), *(F.col(f"l.{c}") for c in ("minx", "miny", "maxx", "maxy"))))
        own = pairs.select(F.col(f"l.{window_id}").alias(window_id), size.alias("size")).where("size > 0")
        own = own.groupBy(window_id).agg(F.count("*").alias(f"{name}_count"), F.sum("size").alias(f"{name}_area"))
        out = out.join(own, window_id, "left")
    out = out.na.fill(0)
    share = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    return out.withColumns({"array_to_panel_ratio": share("array_area", "panel_area"), "panel_coverage_pct": share("panel_area", "building_area") * 100})


def union_of_boxes(boxes: np.ndarray) -> float:
    """Area that rows (minx, miny, maxx, maxy) cover together.

    Boxes that span the whole stretch of x leave only their sides along y; the rest is halved at the middle of
    their ends, so every part has fewer ends inside and the work stays near n log n.
    """
    total, todo = 0.0, [(boxes, boxes[:, 0].min(), boxes[:, 2].max())] if len(boxes) else []
    while todo:
        b, left, right = todo.pop()
        spans = (b[:, 0] <= left) & (b[:, 2] >= right)
        low, high = b[spans, 1], b[spans, 3]
        order = np.argsort(low)
        low, top = low[order], np.maximum.accumulate(high[order])
        starts = np.flatnonzero(np.append(True, low[1:] > top[:-1])) if len(low) else np.empty(0, int)
        low, high = low[starts], top[np.append(starts[1:], len(top)) - 1] if len(starts) else low
        if spans.all():
            total += (right - left) * float(np.sum(high - low))
            continue
        ends = np.sort(np.concatenate([b[~spans, 0], b[~spans, 2]]))
        ends = ends[(ends > left) & (ends < right)]
        middle = ends[len(ends) // 2]
        whole = np.column_stack([np.full(len(low), left), low, np.full(len(low), right), high])
        rest = np.concatenate([b[~spans], whole])
        for x0, x1 in ((left, middle), (middle, right)):
            own = rest[(rest[:, 0] < x1) & (rest[:, 2] > x0)]
            if len(own):
                todo.append((own, x0, x1))
    return total


def _tiles(pieces: DataFrame, area_id: str) -> tuple[DataFrame, DataFrame]:
    """Tiles that one footprint covers whole, and the pieces of footprints in the others (area_id, tile and geom).

    A footprint that covers a tile leaves nothing to be found there, whatever else lies in it. Other tiles are quartered,
    with their pieces, while they have more edges than a task takes at once. So what is worked on are the surroundings
    of the covered area's boundary, however many footprints lie one upon the other.
    """
    key = [area_id, *_TILE]
    whole, small = [], []
    for level in range(QUARTERED + 1):
        size = (F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0"))
        full = (F.size("geom.rings") == 1) & (g.area(F.col("geom")) >= size * (1 - 1e-12))
        # copies of a piece are one
        one = pieces.withColumns({"__p": F.xxhash64("geom"), "__q": F.xxhash64(F.lit(1), "geom"), "__full": full}).dropDuplicates([*key, "__p", "__q"])
        one = saved(one.drop("__p", "__q"), "pieces")
        n = F.aggregate("geom.rings", F.lit(0).cast("long"), lambda a, r: a + F.size(r))
        tiles = saved(one.groupBy(*key).agg(F.max("__full").alias("__any"), F.sum(n).alias("__n")), "tiles")
        whole.append(tiles.where("__any").select(key))
        last = level == QUARTERED
        crowded = F.lit(False) if last else F.col("__n") > PER_TASK // 2
        small.append(one.join(tiles.where(~F.col("__any") & ~crowded).select(key), key, "left_semi").select(*key, "geom"))
        rest = tiles.where(~F.col("__any") & crowded).select(key)
        if last or rest.isEmpty():
            break
        mx, my = (F.col("tx0") + F.col("tx1")) / 2, (F.col("ty0") + F.col("ty1")) / 2
        quarters = [(a, b, c, d) for a, c in ((F.col("tx0"), mx), (mx, F.col("tx1"))) for b, d in ((F.col("ty0"), my), (my, F.col("ty1")))]
        quarter = F.explode(F.array(*(F.struct(*(c.alias(k) for k, c in zip(_TILE, q))) for q in quarters)))
        cut = one.join(rest, key, "left_semi").select(area_id, quarter.alias("t"), "geom")
        box = g.envelope(F.col("geom"))
        cut = cut.where((box["minx"] < F.col("t.tx1")) & (box["maxx"] > F.col("t.tx0")) & (box["miny"] < F.col("t.ty1")) & (box["maxy"] > F.col("t.ty0")))
        cut = cut.select(area_id, *(F.col(f"t.{k}").alias(k) for k in _TILE), clipped(F.col("geom"), *(F.col(f"t.{k}") for k in _TILE)).alias("geom"))
        pieces = cut.where("size(geom.rings) > 0")
    return reduce(DataFrame.unionByName, whole), reduce(DataFrame.unionByName, small)


def _covered_by_tiles(pairs: DataFrame, areas: DataFrame, area_id: str, cell: float, digits: int) -> DataFrame:
    """area_id, covered: over pairs of a footprint and an area."""
    key = [area_id, *_TILE]
    bounds = [F.col(f"r.{c}").alias(k) for k, c in zip(_TILE, ("minx", "miny", "maxx", "maxy"))]
    pieces = pairs.select(F.col(f"r.{area_id}").alias(area_id), *bounds, clipped(F.col("l.geom"), *(F.col(f"r.{c}") for c in ("minx", "miny", "maxx", "maxy"))).alias("geom"))
    whole, small = _tiles(pieces.where("size(geom.rings) > 0"), area_id)
    own = lambda tiles: tiles.join(areas.select(area_id, F.col("geom").alias("__area")), area_id).select(*key, clipped(F.col("__area"), *map(F.col, _TILE)).alias("geom"))
    inside = own(whole).select(area_id, g.area(F.col("geom")).alias("covered"))
    edges = boundary(small, key, cell=cell, other=own(small.select(key).distinct()), result="intersection", digits=digits)
    parts = boundary_area(edges, key, "covered").select(area_id, "covered")
    return inside.unionByName(parts).groupBy(area_id).agg(F.sum("covered").alias("covered"))


def covered_area(areas: DataFrame, footprints: DataFrame, *, area_id: str, cell: float, boxes: bool = False, per_strip: int = 1024, digits: int = 9) -> DataFrame:
    """area_id, covered: the area that footprints cover of each area, each spot once; areas that none meets are left out.

    boxes: all shapes are their boxes. Then an area with many footprints is cut into strips, as many as it has
    `per_strip` footprints, so that no task sweeps all of them. Else an area's box is quartered again and again, see
    `_tiles`, and the boundary of what footprints and area have in common is found by `boundary` tile by tile, and its
    area summed over edges.
    """
    pairs = candidate_pairs(footprints, areas, cell=cell)
    if not boxes:
        return _covered_by_tiles(pairs, areas, area_id, cell, digits)
    side = lambda f, c: f(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c)
    cut = pairs.select(F.col(f"r.{area_id}").alias(area_id), F.col("r.minx").alias("x0"), F.col("r.maxx").alias("x1"), side(F.greatest, "minx"), side(F.greatest, "miny"), side(F.least, "maxx"), side(F.least, "maxy"))
    cut = saved(cut.where("minx < maxx AND miny < maxy").distinct(), "cut")
    n = cut.groupBy(area_id).agg(F.ceil(F.count("*") / per_strip).alias("strips"))
    width = (F.col("x1") - F.col("x0")) / F.col("strips")
    number = lambda c: F.least(F.floor((F.col(c) - F.col("x0")) / width), F.col("strips") - 1)
    rows = cut.join(n, area_id).withColumn("strip", F.explode(F.sequence(number("minx"), number("maxx"))))
    start = F.col("x0") + F.col("strip") * width
    rows = rows.withColumns({"minx": F.greatest("minx", start), "maxx": F.least(F.col("maxx"), F.when(F.col("strip") == F.col("strips") - 1, F.col("x1")).otherwise(F.col("x0") + (F.col("strip") + 1) * width))})
    kind = dict(areas.dtypes)[area_id]

    def swept(table: pa.Table) -> pa.Table:
        found = union_of_boxes(np.column_stack([table.column(c).to_numpy() for c in ("minx", "miny", "maxx", "maxy")]))
        return pa.table([table.column(area_id).slice(0, 1), pa.array([found])], [area_id, "part"])

    rows = rows.where("minx < maxx").select(area_id, "strip", "minx", "miny", "maxx", "maxy")
    return rows.groupBy(area_id, "strip").applyInArrow(swept, f"`{area_id}` {kind}, part double").groupBy(area_id).agg(F.sum("part").alias("covered"))
