"""Area summaries and spatial statistics."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import ranges_of, saved

#: Groups of up to so many areas are permuted by arrays, so many permutations in a task; larger ones by joins.
PER_TASK = 1 << 18
AT_ONCE = 50


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value * weight by sum of weight; null if that is 0."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0)))


def flagged(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0)))


def area_stats(value: str) -> list[Column]:
    """min, mean, exact p50 and p90, max."""
    q = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.9)))
    return [F.min(value).alias("min"), F.avg(value).alias("mean"), q[0].alias("p50"), q[1].alias("p90"), F.max(value).alias("max")]


def zonal_stats(pixels: DataFrame, zone: str, tile: str = "tile_id", value: str = "value") -> DataFrame:
    """Per zone: pixel-weighted means over tiles of each tile's mean, p10 and p90, and the number of valid pixels.

    Nulls, NaN and infinities don't count; percentiles are averaged over tiles and not taken anew. `pooled_p10` and
    `pooled_p90` are those of all pixels of the zone together.
    """
    v = F.col(value)
    valid = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    by_tile = valid.groupBy(zone, tile).agg(F.avg(value).alias("mean"), q.alias("q"), F.count("*").alias("n"))
    by_tile = by_tile.select(zone, "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"), "n")
    out = by_tile.groupBy(zone).agg(*(weighted_mean(c, "n").alias(c) for c in ("mean", "p10", "p90")), F.sum("n").alias("pixel_count"))
    pooled = percentiles(valid, value, [0.1, 0.9], [zone]).select(zone, F.col("q")[0].alias("pooled_p10"), F.col("q")[1].alias("pooled_p90"))
    return out.join(pooled, zone)


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] = (), parts: int | None = None) -> DataFrame:
    """Per group `q`: exact percentiles of the values that aren't null, interpolated; groups without any are left out.

    Equal values are counted first; then distinct ones are dealt into ranges, and running counts taken inside each
    range: no task gets all values of a group.
    """
    x = F.col(value).cast("double").alias("__v")
    values = df.where(F.col(value).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__n"))
    dealt = saved(values.repartitionByRange(ranges_of(values, parts), *by, "__v").withColumn("__part", F.spark_partition_id()), "values")
    w = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col("__part").alias("__p"), before.alias("__before"), F.sum("__sum").over(w).alias("__all"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    run = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.withColumn("__run", run).join(sums, same).withColumn("__last", F.col("__before") + F.col("__run") - 1).withColumn("__first", F.col("__last") - F.col("__n") + 1)
    picks = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("__first") <= place) & (place <= F.col("__last")), F.col("__v"))).alias(f"__{end}{i}"))
    found = rows.groupBy(*by).agg(*picks, F.max("__all").alias("__all"))
    q = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        between = (F.ceil(at) - at) * F.col(f"__lo{i}") + (at - F.floor(at)) * F.col(f"__hi{i}")
        q.append(F.when(F.ceil(at) == F.floor(at), F.col(f"__lo{i}")).otherwise(between))
    return found.select(*by, F.array(*q).alias("q"))


def quantile_class(df: DataFrame, value: str, k: int = 5, by: list[str] = ()) -> DataFrame:
    """df with `quantile_class` 0 to k - 1 by exact percentiles; a value at a break falls into the lower class, null stays null."""
    cuts = percentiles(df, value, [i / k for i in range(1, k)], by).withColumnsRenamed({"q": "__b", **{c: f"__{c}" for c in by}})
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = df.join(cuts, same, "left").drop(*(f"__{c}" for c in by))
    else:
        out = df.join(F.broadcast(cuts), how="left") if not cuts.isEmpty() else df.withColumn("__b", F.lit(None).cast("array<double>"))  # one row
    above = F.aggregate(F.col("__b"), F.lit(0), lambda n, b: n + (F.col(value) > b).cast("int"))
    return out.withColumn("quantile_class", F.when(F.col(value).isNotNull(), above)).drop("__b")


def robust_range(value: str, least: int = 10) -> list[Column]:
    """p5 and p95 if there are enough values, else min and max."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return [F.when(F.count(value) >= least, q[0]).otherwise(F.min(value)).alias("low"), F.when(F.count(value) >= least, q[1]).otherwise(F.max(value)).alias("high")]


def contrast_stretch(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """pixels with `stretched`: 0 at the group's p2, 1 at its p98, clipped; null if these are equal."""
    q = pixels.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98))).alias("__q"))
    x = F.try_divide(F.col(value) - F.col("__q")[0], F.nullif(F.col("__q")[1] - F.col("__q")[0], F.lit(0.0)))
    return pixels.join(q, by).withColumn("stretched", F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))).drop("__q")


def _dealt_by_joins(z: DataFrame, links: DataFrame, permutations: int, seed: int) -> DataFrame:
    """g, perm, num, s0: the sum over links of weight and both values as dealt, and that of weights. Permutation 0 is the given order."""
    draws = z.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    order = F.when(F.col("perm") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("perm").cast("string"), F.col("id").cast("string"))))
    position = F.row_number().over(Window.partitionBy("g", "perm").orderBy(order, "id"))
    dealt = draws.withColumn("at", position).select("g", "perm", "at", "z")
    a = dealt.select("g", "perm", F.col("at").alias("ps"), F.col("z").alias("zs"))
    b = dealt.select("g", "perm", F.col("at").alias("pd"), F.col("z").alias("zd"))
    return links.join(a, ["g", "ps"]).join(b, ["g", "pd", "perm"]).groupBy("g", "perm").agg(F.sum(F.col("w") * F.col("zs") * F.col("zd")).alias("num"), F.sum("w").alias("s0"))


def _dealt_by_arrays(z: DataFrame, links: DataFrame, permutations: int, seed: int) -> DataFrame:
    """As `_dealt_by_joins`: a group's areas and links go once to each task of `AT_ONCE` permutations, where they are arrays."""
    near = links.groupBy("g", F.col("ps").alias("p")).agg(F.array_sort(F.collect_list(F.struct("pd", "w"))).alias("near"))
    chunk = F.explode(F.sequence(F.lit(0), F.lit(permutations // AT_ONCE)))
    rows = z.join(near, ["g", "p"], "left").select("g", chunk.alias("chunk"), F.col("id").cast("string").alias("id"), "p", "z", F.col("near.pd").alias("to"), F.col("near.w").alias("w"))

    def of_chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by("p").combine_chunks()
        values, to = table.column("z").to_numpy(), table.column("to").combine_chunks()
        src = to.value_parent_indices().to_numpy()
        dst, w = to.flatten().to_numpy() - 1, table.column("w").combine_chunks().flatten().to_numpy()
        names = [n.encode() for n in table.column("id").to_pylist()]
        lo = table.column("chunk")[0].as_py() * AT_ONCE
        perms = range(lo, min(lo + AT_ONCE, permutations + 1)) if len(src) else ()
        num = []
        for perm in perms:
            drawn = values
            if perm:
                start = hashlib.md5(f"{seed}-{perm}-".encode(), usedforsecurity=False)
                digests = bytearray()
                for n in names:
                    h = start.copy()
                    h.update(n)
                    digests += h.digest()
                key = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
                drawn = values[np.lexsort((key[:, 1], key[:, 0]))]
            num.append(float(np.sum(w * drawn[src] * drawn[dst])))
        at = pa.array(np.zeros(len(num), np.int64))
        return pa.table([table.column("g").take(at), pa.array(list(perms), pa.int32()), pa.array(num, pa.float64()), pa.array([float(w.sum())] * len(num), pa.float64())], ["g", "perm", "num", "s0"])

    return rows.groupBy("g", "chunk").applyInArrow(of_chunk, f"g {rows.schema['g'].dataType.simpleString()}, perm int, num double, s0 double")


def morans_i(values: DataFrame, edges: DataFrame, *, area_id: str, value: str, by: str, permutations: int = 0, seed: int = 1, least: int = 5) -> DataFrame:
    """Per group: n, moran_i and, with permutations, pseudo_p and z; groups with fewer than `least` areas are left out.

    edges: src, dst, w, of which those between areas of one group with a value count, each row's weights scaled to 1.
    A permutation deals a group's values anew in the order of the MD5 of seed, permutation and area, joined by
    hyphens, so that any engine gets the same ones.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(area_id).alias("id"), F.col(value).cast("double").alias("v"))
    stats = rows.groupBy("g").agg(F.avg("v").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("g").orderBy("id"))
    z = rows.join(stats, "g").select("g", "id", (F.col("v") - F.col("m")).alias("z"), "n").withColumn("p", place)
    z = saved(z, "areas") if permutations else z
    src, dst = z.select(F.col("g").alias("gs"), F.col("id").alias("src"), "n", F.col("p").alias("ps")), z.select(F.col("g").alias("gd"), F.col("id").alias("dst"), F.col("p").alias("pd"))
    inner = edges.join(src, "src").join(dst, "dst").where("gs = gd")
    inner = inner.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select(F.col("gs").alias("g"), "n", "ps", "pd", "w")
    if not permutations:
        cross = _dealt_by_joins(z, inner, permutations, seed)
    else:
        inner = saved(inner, "links")
        few, many = F.col("n") <= PER_TASK, F.col("n") > PER_TASK
        cross = _dealt_by_arrays(z.where(few), inner.where(few), permutations, seed)
        if not stats.where(many).isEmpty():
            cross = cross.unionByName(_dealt_by_joins(z.where(many), inner.where(many), permutations, seed))
    scale = z.groupBy("g").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("n").alias("n"))
    i = cross.join(scale, "g").withColumn("i", F.try_divide(F.col("n") * F.col("num"), F.nullif(F.col("s0") * F.col("zz"), F.lit(0.0))))
    seen = i.where("perm = 0").select("g", "n", F.col("i").alias("moran_i"))
    if not permutations:
        return seen.withColumnRenamed("g", by)
    drawn = i.where("perm > 0").join(seen.select("g", "moran_i"), "g").groupBy("g").agg(
        F.sum((F.col("i") >= F.col("moran_i")).cast("int")).alias("larger"), F.avg("i").alias("mean_i"), F.stddev_pop("i").alias("sd_i")
    )
    larger = F.least("larger", F.lit(permutations) - F.col("larger"))
    out = seen.join(drawn, "g").withColumn("pseudo_p", (larger + 1) / F.lit(permutations + 1)).withColumn("z", F.try_divide(F.col("moran_i") - F.col("mean_i"), F.nullif("sd_i", F.lit(0.0))))
    return out.select(F.col("g").alias(by), "n", "moran_i", "pseudo_p", "z")
