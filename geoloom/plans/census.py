"""Geography rollups: levels of a census-style hierarchy, demographic metrics, urban shares, vintages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import haversine_m
from ..functions.scalars import diversity, geoid, numeric, row_sum, safe_ratio, without_sentinel, zero_filled


@dataclass(frozen=True)
class Level:
    """A level of the hierarchy: the length of its identifier, whose beginnings are its parents'."""

    name: str
    digits: int
    aliases: tuple[str, ...] = ()


LEVELS = [Level("state", 2), Level("county", 5, ("counties", "municipio")), Level("tract", 11, ("tracts",)), Level("block_group", 12, ("block_groups", "bg", "block group")), Level("block", 15, ("blocks",))]


def level(name: str) -> Level:
    key = name.strip().lower()
    for x in LEVELS:
        if key in (x.name, *x.aliases):
            return x
    raise ValueError(f"no level {name!r}; there are {', '.join(x.name for x in LEVELS)}")


def parent(c: Column, name: str) -> Column:
    """The identifier of the parent at a level; null if the identifier is shorter."""
    n = level(name).digits
    return F.when(F.length(c) >= n, F.substring(c, 1, n))


def block_identifiers(raw: DataFrame) -> DataFrame:
    """Raw block rows (STATE, COUNTY, TRACT, BLOCK in any case) with block_geoid, bg_geoid, tract_geoid, county_geoid."""
    df = raw.toDF(*(c.strip().upper() for c in raw.columns))
    if missing := {"STATE", "COUNTY", "TRACT", "BLOCK"} - set(df.columns):
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    full = geoid((F.col("STATE"), 2), (F.col("COUNTY"), 3), (F.col("TRACT"), 6), (F.col("BLOCK"), 4))
    df = df.withColumn("block_geoid", full)
    return df.withColumns({"bg_geoid": parent(full, "bg"), "tract_geoid": parent(full, "tract"), "county_geoid": parent(full, "county")})


def demographic_metrics(df: DataFrame, *, groups: list[str], total: str, owner: str, tenure: str, schooling: list[str], adults: str, poor: str, poverty_base: str) -> DataFrame:
    """df, whose estimates may be text with codes for missing, with numbers and derived shares."""
    columns = dict.fromkeys([*groups, total, owner, tenure, *schooling, adults, poor, poverty_base])
    df = df.withColumns({c: without_sentinel(numeric(F.col(c))) for c in columns})
    c = F.col
    return df.withColumns(
        {
            "owner_share": safe_ratio(c(owner), c(tenure)),
            "schooling_share": safe_ratio(row_sum([c(x) for x in schooling], True), c(adults)),
            "poverty_share": safe_ratio(c(poor), c(poverty_base)),
            "largest_share": safe_ratio(F.greatest(*(c(x) for x in groups)), c(total)),
            "diversity_index": diversity([c(x) for x in groups], c(total)),
        }
    )


def survey_frame(
    raw: DataFrame, *, level: str, names: dict[str, str], parts: dict[str, int], geoid_column: str, sums: dict[str, list[str]], shares: dict[str, tuple[list[str], str]], groups: list[str] = (), total: str = "", keep: list[str] = ()
) -> DataFrame:
    """A survey's raw rows as a table of one level: coded columns by name, numbers, an identifier, sums and shares.

    names: code to name; parts: the identifier's columns and widths, in order. sums: name to columns, null if all
    of them are null. shares: name to columns and base, nulls of the columns counting 0, null over a null or zero
    base. groups and total: for the diversity index. Columns: level, parts, identifier, `keep`, the named ones, sums, index,
    shares, each once and only if the table has it. Codes that the table hasn't are skipped; codes for missing are null.
    """
    have = {c: n for c, n in names.items() if c in raw.columns}
    out = raw.withColumns({c: without_sentinel(numeric(F.col(c).cast("string"))) for c in have}).withColumnsRenamed(have)
    out = out.withColumns({geoid_column: geoid(*((F.col(c), w) for c, w in parts.items())), "geography_level": F.lit(level)})
    known = lambda cols: [F.col(c) for c in cols if c in have.values()] or [F.lit(None).cast("double")]
    out = out.withColumns({k: row_sum(known(cols), True) for k, cols in sums.items()})
    made = [c for c in sums]
    base = lambda c: F.col(c) if c in [*have.values(), *made] else F.lit(None).cast("double")
    of = lambda cols: row_sum([base(c) for c in cols], False)
    single = lambda cols: base(cols[0]) if len(cols) == 1 else of(cols)  # noqa: E731  one column alone stays null
    out = out.withColumns({k: safe_ratio(single(cols), base(b)) for k, (cols, b) in shares.items()})
    if groups:
        out = out.withColumn("diversity_index", diversity([base(c) for c in groups], base(total)))
    order = ["geography_level", *parts, geoid_column, *keep, *names.values(), *sums, "diversity_index", *shares]
    return out.select(*dict.fromkeys(c for c in order if c in out.columns))


def urban_rollup(areas: DataFrame, blocks: DataFrame, acs: DataFrame, *, name: str) -> DataFrame:
    """Areas of a level (geoid, land_m2) with sums over their urban blocks and demographic counts; shares null without a base."""
    sums = blocks.groupBy(parent(F.col("block_geoid"), name).alias("geoid")).agg(
        F.count("*").alias("urban_blocks"), F.sum("pop").alias("urban_pop"), F.sum("housing").alias("urban_housing"), F.sum("land_m2").alias("urban_land_m2")
    )
    people = acs.groupBy(parent(F.col("bg_geoid"), name).alias("geoid")).agg(F.sum("population").alias("population"))
    out = areas.join(sums, "geoid", "left").join(people, "geoid", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("urban_blocks", "urban_pop", "urban_housing", "urban_land_m2")}
    out = out.withColumns(filled)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
    return out.withColumns({"urban_pop_ratio": share("urban_pop", "population"), "urban_land_share": share("urban_land_m2", "land_m2"), "is_urban": F.col("urban_blocks") > 0})


def rollup_quality(levels: dict[str, DataFrame]) -> DataFrame:
    """Per level: rows, urban rows, rows whose ratio exceeds 1, median and largest ratio."""
    parts = [
        df.agg(
            F.lit(n).alias("level"),
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.col("is_urban").cast("int")), F.lit(0)).alias("urban_rows"),
            F.coalesce(F.sum((F.col("urban_pop_ratio") > 1).cast("int")), F.lit(0)).alias("above_one"),
            F.median("urban_pop_ratio").alias("median_ratio"),
            F.max("urban_pop_ratio").alias("max_ratio"),
        )
        for n, df in levels.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def vintage_comparison(old: DataFrame, new: DataFrame, *, near: float = 0.999) -> DataFrame:
    """Boxes of two vintages by geoid: overlap shares of either, distance of centres, and a status.

    new and missing for one-sided rows, exact for equal boxes, near if both shares reach `near`, else changed.
    """
    a = old.select("geoid", F.struct("minx", "miny", "maxx", "maxy").alias("a"))
    b = new.select("geoid", F.struct("minx", "miny", "maxx", "maxy").alias("b"))
    j = a.join(b, "geoid", "full")
    side = lambda lo, hi: F.greatest(F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")) - F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")), F.lit(0.0))
    size = lambda t: (F.col(f"{t}.maxx") - F.col(f"{t}.minx")) * (F.col(f"{t}.maxy") - F.col(f"{t}.miny"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    over = F.when(both, side("minx", "maxx") * side("miny", "maxy"))
    mid = lambda t, lo, hi: (F.col(f"{t}.{lo}") + F.col(f"{t}.{hi}")) / 2
    out = j.withColumns({"old_share": safe_ratio(over, size("a")), "new_share": safe_ratio(over, size("b"))})
    far = F.when(both, haversine_m(mid("a", "minx", "maxx"), mid("a", "miny", "maxy"), mid("b", "minx", "maxx"), mid("b", "miny", "maxy")))
    status = (
        F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "exact")
        .when((F.col("old_share") >= near) & (F.col("new_share") >= near), "near").otherwise("changed")
    )
    return out.withColumns({"distance_m": far, "status": status}).drop("a", "b")


def vintage_overlaps(status: DataFrame) -> DataFrame:
    """One row over the areas of both vintages: rows, and mean, least and greatest of either share, and of the distance."""
    both = status.where(F.col("old_share").isNotNull() & F.col("new_share").isNotNull())
    names = {"avg": F.avg, "min": F.min, "max": F.max}
    return both.agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in ("old_share", "new_share", "distance_m") for n, f in names.items()))


def vintage_guidance(status: DataFrame) -> DataFrame:
    """One row: the number of each status, and advice. No rows at all count as equal vintages; null statuses don't count."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0))
    counts = status.agg(*(n(s).alias(s) for s in ("new", "missing", "exact", "near", "changed")))
    moved, one_sided, alike = F.col("changed") > 0, F.col("new") + F.col("missing") > 0, F.col("exact") + F.col("near") > 0
    advice = (
        F.when(~moved & ~one_sided, "vintages are the same: join by geoid is safe")
        .when(~moved, "areas in both agree, but some are in one only: review those, or relate vintages by overlap")
        .when(~alike, "vintages differ: stay with one")
        .otherwise("many areas agree, some moved: check those first")
    )
    return counts.withColumn("advice", advice)


def restricted_tables(catalog: DataFrame, restriction: str, table: str, chosen: list[str], summary_level: str) -> DataFrame:
    """Chosen tables whose restriction text names the summary level; for a check that fails unless it is empty."""
    base = F.regexp_extract(F.col(table), "^([A-Z]+[0-9]+[A-Z]*)", 1)
    return catalog.where(base.isin(chosen) & F.coalesce(F.col(restriction).contains(summary_level), F.lit(False)))


def county_filter(df: DataFrame, column: str, state: str) -> DataFrame:
    return df.where(zero_filled(F.col(column), 2) == state)
