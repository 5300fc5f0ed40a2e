"""Imagery catalogs: items of many shapes into one table, asset choice, traversal of linked documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box, envelope, intersects, signed_area
from ..functions.scalars import canonical_json, resolve_href, timestamp
from ..operators.tables import first_per
from ..sources.files import saved, shared_folder


def extracted(columns: list[str], *names: str, properties: str = "properties") -> Column:
    """The first of the names that is a column or a property with a value."""
    found = []
    for n in names:
        if n in columns:
            found.append(F.col(f"`{n}`").cast("string"))
        if properties in columns:
            found.append(F.try_element_at(properties, F.lit(n)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def bounds(bbox: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy of an array of four or (with heights) six numbers; null for other sizes."""
    four, six = F.size(bbox) == 4, F.size(bbox) == 6
    pick = lambda a, b: F.when(four, F.get(bbox, a)).when(six, F.get(bbox, b)).cast("double")
    return {"minx": pick(0, 0), "miny": pick(1, 1), "maxx": pick(2, 3), "maxy": pick(3, 4)}


def box_bounds(items: DataFrame) -> dict[str, Column]:
    """minx, miny, maxx, maxy of the column `bbox`: an array, or a struct or map of xmin, ymin, xmax, ymax or of minx, miny, maxx, maxy; null without one."""
    names = ("minx", "miny", "maxx", "maxy")
    kind = items.schema["bbox"].dataType if "bbox" in items.columns else None
    if isinstance(kind, T.ArrayType):
        return bounds(F.col("bbox"))
    other = {"minx": "xmin", "miny": "ymin", "maxx": "xmax", "maxy": "ymax"}
    if isinstance(kind, T.MapType):
        pick = lambda ns: [F.try_element_at("bbox", F.lit(n)).cast("double") for n in ns]
        sets = [pick([other[n] for n in names]), pick(names)]
    elif isinstance(kind, T.StructType):
        sets = [[F.col(f"bbox.{n}").cast("double") for n in ns] for ns in ([other[n] for n in names], names) if set(ns) <= set(kind.names)]
    else:
        sets = []
    out = dict.fromkeys(names, F.lit(None).cast("double"))
    for four in reversed(sets):
        whole = F.lit(True)
        for c in four:
            whole = whole & c.isNotNull()
        out = {n: F.when(whole, c).otherwise(out[n]) for n, c in zip(names, four)}
    return out


def self_link(href: Column, links: Column) -> Column:
    return F.coalesce(href, F.get(F.filter(links, lambda x: x.rel == "self"), 0).href)


def picked_asset(assets: Column, exact: list[str], roles: list[str], keywords: list[str], blocked: list[str], fallback: bool = False) -> Column:
    """The asset (of an array of struct<name, href, title, roles> in document order) by a ladder; null without one.

    Only assets with a link count. The steps: the first of the exact names, as written; the first asset with any
    of the roles; the first with any of the keywords in its name, title or link; if asked, the first. Case
    doesn't matter for roles and keywords. A blocked word in a name rules an asset out on all steps but the first.
    """
    linked = F.filter(assets, lambda a: F.coalesce(F.trim(a.href), F.lit("")) != "")
    has_any = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    free = F.filter(linked, lambda a: ~F.coalesce(has_any(F.lower(a["name"]), blocked), F.lit(False))) if blocked else linked

    def first(of: Column, test) -> Column:
        return F.get(F.filter(of, lambda a: F.coalesce(test(a), F.lit(False))), 0)

    steps = [first(linked, lambda a, name=name: a["name"] == name) for name in exact]
    if roles:
        steps.append(first(free, lambda a: F.arrays_overlap(F.transform(a.roles, F.lower), F.array(*map(F.lit, roles)))))
    if keywords:
        steps.append(first(free, lambda a: has_any(F.lower(F.concat_ws("\n", a["name"], a.title, a.href)), keywords)))
    if fallback:
        steps.append(F.get(free, 0))
    return F.coalesce(*steps) if steps else F.get(F.filter(assets, lambda a: F.lit(False)), 0)


def normalised_items(items: DataFrame, source: str, *, exact: list[str], roles: list[str], keywords: list[str], blocked: list[str]) -> DataFrame:
    """One schema for items of any source: ids, time, box, chosen asset, resolution, projection, asset names, self link."""
    c = items.columns
    has = lambda n, otherwise: F.col(n) if n in c else otherwise
    asset = picked_asset(F.col("assets"), exact, roles, keywords, blocked) if "assets" in c else F.lit(None)
    epsg = extracted(c, "proj:epsg", "epsg", "proj:code")
    out = items.withColumn("__asset", asset).withColumns({f"__{k}": v for k, v in bounds(F.col("bbox")).items()} if "bbox" in c else {})
    return out.select(
        F.lit(source).alias("source"),
        F.col("id").cast("string").alias("item_id"),
        extracted(c, "collection").alias("collection"),
        timestamp(extracted(c, "datetime", "start_datetime", "acquired")).alias("acquired"),
        *(has(f"__{k}", F.lit(None).cast("double")).alias(k) if "bbox" not in c else F.col(f"__{k}").alias(k) for k in ("minx", "miny", "maxx", "maxy")),
        F.col("__asset.name").alias("asset_role"),
        F.col("__asset.href").alias("asset_href"),
        extracted(c, "gsd", "eo:gsd").try_cast("double").alias("gsd_m"),
        F.regexp_extract(epsg, "([0-9]+)$", 1).try_cast("int").alias("epsg"),
        (F.to_json(F.array_sort(F.transform("assets", lambda a: a["name"]))) if "assets" in c else F.lit("[]")).alias("asset_names"),
        (self_link(extracted(c, "self_href"), F.col("links")) if "links" in c else extracted(c, "self_href")).alias("self_href"),
    )


#: By kind of asset the exact names, roles, keywords and blocked words of its choice.
LADDERS = {
    "primary": ([], ["data"], ["visual", "analytic", "image", "rgb"], ["thumbnail", "preview"]),
    "visual": (["visual", "image"], ["visual"], ["visual", "rgb"], ["thumbnail", "preview", "analytic"]),
    "analytic": (["analytic", "data"], ["data"], ["analytic", "cog", "ortho", "ms", "nir"], ["thumbnail", "preview", "visual"]),
    "preview": (["preview"], [], ["preview", "overview"], []),
    "thumbnail": (["thumbnail"], [], ["thumbnail", "thumb"], []),
}

#: Columns and the names under which items have them.
TEXTS = {"item_id": ("id",), "collection_id": ("collection",), "stac_version": ("stac_version",), "license": ("license",), "platform": ("platform",), "constellation": ("constellation",), "grid_code": ("grid:code",), "proj_code": ("proj:code",)}
NUMBERS = {"gsd": ("gsd", "eo:gsd", "proj:gsd"), "cloud_cover": ("eo:cloud_cover", "cloud_cover"), "view_off_nadir": ("view:off_nadir", "sat:off_nadir")}


def catalog_rows(items: DataFrame, source: str, strategy: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """The catalog's columns for items of any source: ids, time, texts, numbers, projection, five chosen assets, asset names, box; and those of `keep`.

    The box is bbox's or, without a usable one, that of `geom`; items with neither are left out. Blank texts and
    numbers that don't parse are null. The primary asset stands in for a missing visual one.
    """
    c = items.columns
    text = lambda *names: F.nullif(F.trim(extracted(c, *names)), F.lit(""))
    assets = F.col("assets") if "assets" in c else F.lit(None).cast("array<struct<name:string,href:string,title:string,roles:array<string>>>")
    chosen = {k: picked_asset(assets, *ladder, fallback=k == "primary") for k, ladder in LADDERS.items()}
    corners = box_bounds(items)
    if "geom" in c:
        corners = {k: F.when(corners["maxy"].isNotNull(), v).otherwise(envelope(F.col("geom"))[k]) for k, v in corners.items()}
    out = items.withColumns({f"__{k}": v for k, v in chosen.items()})
    picked = lambda kind, part: F.col(f"__{kind}")[part]
    names = {}
    for kind in LADDERS:
        for part in ("name", "href"):
            names[f"{kind}_asset_{part}"] = F.coalesce(picked(kind, part), picked("primary", part)) if kind == "visual" else picked(kind, part)
    code = text("proj:code")
    epsg = F.coalesce(text("proj:epsg", "epsg").try_cast("double").cast("int"), F.regexp_extract(code, "(?i)^EPSG:([0-9]+)$", 1).try_cast("int"))
    rows = out.select(
        F.lit(source).alias("source"),
        F.lit(strategy).alias("strategy"),
        *(text(*n).alias(k) for k, n in TEXTS.items()),
        *(text(*n).try_cast("double").alias(k) for k, n in NUMBERS.items()),
        F.coalesce(text("type"), F.lit("Feature")).alias("item_type"),
        timestamp(text("datetime", "start_datetime")).alias("acquired_at"),
        epsg.alias("proj_epsg"),
        (self_link(text("self_href"), F.col("links")) if "links" in c else text("self_href")).alias("self_href"),
        *(v.alias(k) for k, v in names.items()),
        F.greatest(F.coalesce(F.size(assets), F.lit(0)), F.lit(0)).alias("asset_count"),
        F.coalesce(F.to_json(F.array_sort(F.transform(assets, lambda a: a["name"]))), F.lit("[]")).alias("available_asset_names"),
        *(v.alias(f"bbox_{k}") for k, v in corners.items()),
        *(v.alias(k) for k, v in (keep or {}).items()),
    )
    return rows.where("bbox_minx IS NOT NULL AND bbox_miny IS NOT NULL AND bbox_maxx IS NOT NULL AND bbox_maxy IS NOT NULL")


#: How the consolidated table chooses where it differs, and its columns.
CONSOLIDATED_VISUAL = (["visual", "image"], ["visual"], ["visual", "rgb"], ["thumbnail", "preview"])
CONSOLIDATED = [
    "source", "item_id", "collection_id", "acquired_at", "platform", "constellation", "gsd", "cloud_cover", "self_href", "visual_asset_href", "analytic_asset_href", "preview_asset_href", "thumbnail_asset_href",
    "asset_count", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "geometry",
]


def consolidated_rows(items: DataFrame, source: str, boundary: Column) -> DataFrame:
    """The consolidated table's 19 columns for items of any source whose geometry meets the boundary.

    The geometry is `geom` or, where that is null or empty, the box as a polygon; items with neither are left out. A
    missing box is the geometry's. The visual asset is the first of all that aren't ruled out if none fits better.
    """
    corners = box_bounds(items)
    own = F.when(F.size("geom.rings") > 0, F.col("geom")) if "geom" in items.columns else F.lit(None)
    shape = F.coalesce(own, F.when(corners["maxy"].isNotNull(), box(*corners.values())))
    assets = F.col("assets") if "assets" in items.columns else F.lit(None).cast("array<struct<name:string,href:string,title:string,roles:array<string>>>")
    visual = picked_asset(assets, *CONSOLIDATED_VISUAL, fallback=True)
    kept = items.withColumns({"geom": shape, "__shown": visual["href"]}).where("geom IS NOT NULL")
    kept = kept.where(intersects("geom", boundary))
    rows = catalog_rows(kept, source, "", keep={"geometry": F.col("geom"), "__shown": F.col("__shown")})
    return rows.withColumn("visual_asset_href", F.col("__shown")).select(CONSOLIDATED)


def merged_items(frames: list[DataFrame], order: list[Column] = ()) -> DataFrame:
    """Union of frames of items (id, collection, datetime or properties): of equal collection and id that of the latest frame stays, latest items first.

    Ids and collections are trimmed, a blank collection is none, and items without an id go. Within a frame the last
    in `order` stays; without an order, or among ties, the greatest by the text of all its plain columns. Sorted by
    time as text, collection and id, all descending.
    """
    clean = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    marked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("__frame", F.lit(i)) for i, f in enumerate(frames)])
    plain = [c for c, t in marked.dtypes if not t.startswith("map") and c != "__frame"]
    has = lambda c: clean(c) if c in marked.columns else F.lit("")
    rows = marked.withColumns({"__id": has("id"), "__collection": has("collection")}).where("__id <> ''")
    tie = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    last = first_per(rows, ["__collection", "__id"], [F.desc("__frame"), *order, F.desc(tie)])
    times = [F.nullif(clean("datetime"), F.lit(""))] if "datetime" in last.columns else []
    if "properties" in last.columns:
        times += [F.nullif(F.trim(F.try_element_at("properties", F.lit(n))), F.lit("")) for n in ("datetime", "start_datetime")]
    when = F.coalesce(*times, F.lit(""))
    return last.orderBy(F.desc(when), F.desc("__collection"), F.desc("__id")).drop("__frame", "__id", "__collection")


def item_json(items: DataFrame, geom: str = "geom") -> Column:
    """A row of items as a JSON item: keys in order at any depth, the geometry as GeoJSON, the box as four numbers, type Feature if it has none."""
    ring = lambda r: F.transform(r, lambda p: F.array(p.x, p.y))
    values = {c: F.col(f"`{c}`") for c in items.columns if c not in (geom, "bbox")}
    if geom in items.columns:
        # a shell, counter-clockwise, starts a polygon; its holes follow
        empty = F.array().cast("array<array<array<array<double>>>>")

        def add(done: Column, r: Column) -> Column:
            starts = (signed_area(F.struct(F.array(r).alias("rings"))) >= 0) | (F.size(done) == 0)
            joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), F.array(ring(r)))))
            return F.when(starts, F.concat(done, F.array(F.array(ring(r))))).otherwise(joined)

        parts = F.aggregate(F.col(f"{geom}.rings"), empty, add)
        shape = F.struct(parts.alias("coordinates"), F.lit("MultiPolygon").alias("type"))
        values["geometry"] = F.when(F.size(f"{geom}.rings") > 0, shape)
    if "bbox" in items.columns:
        corners = box_bounds(items)
        values["bbox"] = F.when(corners["maxy"].isNotNull(), F.array(*corners.values()))
    values["type"] = F.coalesce(values.get("type", F.lit(None)), F.lit("Feature"))
    return canonical_json(values, of=items)


def consolidated(sources: dict[str, Callable[[], DataFrame]], empty: DataFrame) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Union of sources, of rows with equal (source, item_id) the latest; and (source, note, rows) each. A source that fails gives no rows and its error as note."""
    parts, notes = [empty], []
    for name, read in sources.items():
        try:
            df = saved(read().select(empty.columns), "source")  # read once, so that it can't fail later
        except Exception as e:  # one source must not take the others down
            notes.append((name, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}", 0))
            continue
        parts.append(df)
        notes.append((name, "ok", df.count()))
    rows = reduce(DataFrame.unionByName, parts)
    return first_per(rows, ["source", "item_id"], [F.desc_nulls_last("acquired"), F.asc_nulls_last("asset_href")]), notes


def signature_dedup(assets: DataFrame, source_rank: Column) -> DataFrame:
    """Of assets with equal role, time, resolution and box (rounded), that of the best source."""
    keys = {"__g": F.round("gsd_m", 3), **{f"__{c}": F.round(c, 6) for c in ("minx", "miny", "maxx", "maxy")}}
    rows = assets.withColumns(keys).withColumn("__rank", source_rank)
    return first_per(rows, ["asset_role", "acquired", *keys], [F.asc("__rank"), F.asc_nulls_last("item_id")]).drop(*keys, "__rank")


def traversed(docs: DataFrame, roots: DataFrame, save: Callable[[DataFrame], DataFrame], *, prune: Column | None = None, keep_item: Column | None = None, children: bool = True) -> DataFrame:
    """url, level and kind (catalog or item) of all documents reachable from roots over child links, and of these' items.

    docs: url, links array<struct<rel, href>>, and what `prune` and `keep_item` need. Catalogs for which prune
    isn't true are reached but not followed; items for which keep_item isn't true are left out, and links of items
    aren't followed. Each level is an anti-join with what was seen, written into a folder of its own; `save` keeps the links; it ends when a level is
    empty, which happens however deep links go, as no document is reached twice. Null links lead nowhere;
    documents that aren't in docs are left out.
    """
    follow = docs if prune is None else docs.where(F.coalesce(prune, F.lit(False)))
    links = follow.select(F.col("url").alias("base"), F.explode("links").alias("x")).where(F.col("x.rel").isin("child", "item") & F.col("x.href").isNotNull())
    edges = save(links.select("base", F.col("x.rel").alias("rel"), resolve_href(F.col("base"), F.col("x.href")).alias("url")).distinct())
    known, starts = docs.select("url").distinct(), roots.select("url").distinct()
    # links to nowhere and back to the roots go once, so that a level joins only the rest
    child = save(edges.where("rel = 'child'").select("base", "url").join(starts, "url", "left_anti").join(known, "url", "left_semi").select("base", "url")) if children else None
    spark = docs.sparkSession
    root, n = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}", 0

    def put(urls: DataFrame, level: int) -> DataFrame:
        """Write a level beside the earlier ones; none of these is written again."""
        urls.select("url").write.parquet(f"{root}/level={level}")
        return spark.read.schema("url string").parquet(f"{root}/level={level}")

    reached = lambda: spark.read.schema("url string, level int").parquet(root)
    now = put(known.join(starts, "url", "left_semi"), 0)
    while children:
        n += 1
        step = child.join(now.select(F.col("url").alias("base")), "base", "left_semi").select("url").distinct()
        now = put(step.join(reached(), "url", "left_anti"), n)
        if now.isEmpty():
            break
    seen = reached()
    items = edges.where("rel = 'item'").join(seen.withColumnRenamed("url", "base"), "base").groupBy("url").agg((F.min("level") + 1).alias("level"))
    fit = docs if keep_item is None else docs.where(F.coalesce(keep_item, F.lit(False)))
    items = items.join(fit.select("url").distinct(), "url", "left_semi").join(seen, "url", "left_anti")
    return seen.withColumn("kind", F.lit("catalog")).unionByName(items.withColumn("kind", F.lit("item")))


def relevance(catalogs: DataFrame, children: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Catalogs judged by their own box or, without one, by their children's: status own, child, outside or unknown, and whether relevant."""
    meets = (F.col("minx") <= area[2]) & (F.col("maxx") >= area[0]) & (F.col("miny") <= area[3]) & (F.col("maxy") >= area[1])
    below = children.groupBy(F.col("parent").alias("url")).agg(F.max(meets).alias("child_meets"), F.count(F.when(meets, 1)).alias("children_inside"))
    out = catalogs.withColumn("own_meets", meets).join(below, "url", "left")
    status = F.when(F.col("own_meets"), "own").when(F.col("own_meets").isNull() & F.col("child_meets"), "child")
    status = status.when(F.col("own_meets").isNull() & F.col("child_meets").isNull(), "unknown").otherwise("outside")
    return out.select("url", status.alias("status"), status.isin("own", "child").alias("relevant"), F.coalesce("children_inside", F.lit(0)).alias("children_inside"))


def resolution_summary(candidates: DataFrame, by: str) -> DataFrame:
    """Per group the items by resolution, as lines such as `3 : ~30 cm`, finest first, and the sources' names."""
    bucket = F.when(F.col("cm") < 45, 30).otherwise(60)
    counts = candidates.where("cm IS NOT NULL").groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: F.format_string("%d : ~%d cm", x.n, x.bucket))
    sources = candidates.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    return sources.join(counts.groupBy(by).agg(F.array_join(lines, "\n").alias("resolutions")), by, "left")
