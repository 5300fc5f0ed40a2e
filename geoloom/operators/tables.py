"""Relational operators: choosing rows, keeping histories, updating, checking.

Orders are total: every ranking takes a last key that makes it so. Nulls order last unless said otherwise.
Null keys form a group of their own in rankings and match nothing in joins. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import ranges_of, saved


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def last_source_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames in which, of rows with equal keys, that of the latest frame stays. Rows with a null key go."""
    marked = [f.withColumn("__source", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    rows = rows.dropna(subset=keys[-1:])
    return first_per(rows, keys, [F.desc("__source")]).drop("__source")


def first_values(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: of each column the first value that isn't null, in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = df.withColumn("__rank", rank)
    least = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in columns]
    return numbered.groupBy(*keys).agg(*least)


def updated(target: DataFrame, changes: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """target with the non-null values of changes (unique by `on`); rows without changes stay."""
    new = changes.select(*on, *(F.col(c).alias(f"__new_{c}") for c in columns))
    out = target.join(new, on, "left")
    for c in columns:
        old = F.col(c) if c in target.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(f"__new_{c}", old))
    return out.drop(*(f"__new_{c}" for c in columns))


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with those of the columns (name: type) that it hasn't, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def kept_columns(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """Those of the columns that exist, in this order without repetition, after the given new ones."""
    return df.select(*(c.alias(n) for n, c in more.items()), *(c for c in dict.fromkeys(columns) if c in df.columns))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def joined_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join; fails if a key repeats on either side."""
    for side in (left, right):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"not one row per {', '.join(on)}")
    return left.join(right, on)


def coverage(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Per group of left: rows, and how many have a match in right."""
    keys = right.select(*on).distinct().withColumn("__hit", F.lit(1))
    return left.join(keys, on, "left").groupBy(*by).agg(
        F.count("*").alias("rows"), F.count("__hit").alias("matched"), (F.count("*") - F.count("__hit")).alias("missing")
    )


def assert_covered(report: DataFrame, by: str, expected: list[str] = ()) -> DataFrame:
    """The report; fails if a group misses rows or an expected group isn't there. The report is small."""
    rows = report.collect()
    bad = [r[by] for r in rows if r.missing] + sorted(set(expected) - {r[by] for r in rows})
    if bad:
        raise ValueError(f"not covered: {bad}")
    return report


def top_with_forced(df: DataFrame, order: list[Column], k: int, evidence: Column, name: str, forced: list[str]) -> DataFrame:
    """The first k rows with evidence, or of all if none has any, and rows of forced names whatever their case."""
    some = df.where(evidence)
    pool = some if not some.isEmpty() else df
    named = df.where(F.lower(name).isin([f.lower() for f in forced]))
    return pool.orderBy(*order).limit(k).unionByName(named).dropDuplicates([name])


def numbered(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """df with `position` (from 0) of each row in its group, and the group's `size`, without one task for a whole group.

    Rows are dealt into ranges of keys and order and written once; ranges are numbered in order, so a row's
    position is the number of its group's rows in earlier ranges and that within its own. The order must be total.
    """
    dealt = saved(df.repartitionByRange(ranges_of(df, parts), *keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(*keys)
    counts = dealt.groupBy(*keys, "__part").count()
    counts = counts.withColumn("__before", F.coalesce(F.sum("count").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("count").over(w))
    counts = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), "__before", "size")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = dealt.withColumn("__own", own).join(counts, same)
    return out.withColumn("position", F.col("__before") + F.col("__own") - 1).drop("__own", "__before", "__part", "__p", *(f"__k{i}" for i in range(len(keys))))


def balanced_sample(df: DataFrame, group: str, order: list[Column], buckets: int, per_bucket: int) -> DataFrame:
    """Per group, the ordered rows are dealt into equal runs (the first ones longer by one where it doesn't come out even), and the first of each run taken."""
    at, short = F.col("position"), F.floor(F.col("size") / buckets)
    more = F.col("size") % buckets
    long = at < more * (short + 1)
    run = F.when(long, F.floor(at / (short + 1))).otherwise(F.floor((at - more * (short + 1)) / F.greatest(short, F.lit(1))) + more)
    place = F.when(long, at % (short + 1)).otherwise((at - more * (short + 1)) % F.greatest(short, F.lit(1)))
    return numbered(df, [group], order).withColumn("bucket", (run + 1).cast("int")).where(place < per_bucket).drop("position", "size")


def balanced_cap(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows, at first as many of each group."""
    groups = max(1, df.select(group).distinct().count())
    return first_per(df, [group], order, -(-most // groups)).orderBy(*order).limit(most)


def hash_order(seed: str, *keys: str) -> Column:
    """An order that looks random and depends on seed and keys alone."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def seeded_sample(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def picks_and_random(df: DataFrame, key: str, picks: list, seed: str | None, n: int, fallback: int = 0) -> DataFrame:
    """The named rows and n others at random (none without a seed); if that is nothing, the first `fallback` rows by key."""
    chosen = df.where(F.col(key).isin(picks)) if picks else df.limit(0)
    if seed is not None and n > 0:
        chosen = chosen.unionByName(seeded_sample(df.where(~F.col(key).isin(picks)) if picks else df, seed, key, n))
    return df.orderBy(F.asc_nulls_last(key)).limit(fallback) if fallback and chosen.isEmpty() else chosen


def first_groups(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """All rows of the first `most` groups. A group's place is that of its first row in order, ties by the group's columns."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").orderBy(*order, *(F.asc_nulls_first(c) for c in group)).limit(most)
    keys = first.select(*(F.col(c).alias(f"__{c}") for c in group))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(keys, same, "left_semi")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The different values of a column that aren't null, in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def table_summary(df: DataFrame, assigned: str, top: int = 20) -> DataFrame:
    """One row: rows, assigned and unassigned ones, and `top`: the values with most rows, n and value, ties by value."""
    counts = df.groupBy(F.col(assigned).cast("string").alias("value")).agg(F.count("*").alias("n"))
    best = counts.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(top)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("top"))  # at most `top` entries
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("assigned"))
    return total.join(F.broadcast(listed)).select("rows", "assigned", (F.col("rows") - F.col("assigned")).alias("unassigned"), F.transform("top", lambda t: F.struct((-t.n).alias("n"), t.value.alias("value"))).alias("top"))


def with_metadata(stage: DataFrame, found: DataFrame, *, stage_id: str, found_id: str, prefix: str, columns: list[str]) -> DataFrame:
    """stage with the non-null values of columns of `found`, whose numeric ids, behind a prefix such as `way/`, are those of stage.

    Ids of stage without the prefix, or whose rest isn't digits, keep what they have. found has one row per id.
    """
    number = F.regexp_extract(F.col(stage_id), f"^{prefix}([0-9]+)$", 1)
    new = found.select(F.col(found_id).cast("long").cast("string").alias("__id"), *(F.col(c).alias(f"__new_{c}") for c in columns))
    own = F.when(number != "", F.regexp_replace(number, "^0+(?=.)", ""))
    out = stage.withColumn("__own", own).join(new, F.col("__own") == F.col("__id"), "left")
    have = lambda c: F.coalesce(f"__new_{c}", c) if c in stage.columns else F.col(f"__new_{c}")
    return out.withColumns({c: have(c) for c in columns}).drop("__own", "__id", *(f"__new_{c}" for c in columns))


def split_of(df: DataFrame, seed: str, key: str, share: float, by: list[str] = ()) -> DataFrame:
    """df with is_validation: the first ceil(n * share) rows in hash order. Ranks are counted in hash ranges, not in one task."""
    cell = F.substring(hash_order(seed, key), 1, 3)
    rows = df.withColumn("__h", hash_order(seed, key)).withColumn("__cell", F.substring("__h", 1, 3))
    cells = rows.groupBy(*by, "__cell").count()
    w = Window.partitionBy(*by).orderBy("__cell")
    cells = cells.withColumn("__before", F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("__all", F.sum("count").over(Window.partitionBy(*by))).drop("count")
    own = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__h", key))
    rows = rows.withColumn("__own", own).join(cells, [*by, "__cell"])
    return rows.withColumn("is_validation", F.col("__own") + F.col("__before") <= F.ceil(F.col("__all") * share)).drop("__h", "__cell", "__before", "__all", "__own")


def file_set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """For every key of either table: both, only_a or only_b."""
    left, right = (df.select(key).distinct().withColumn(m, F.lit(1)) for df, m in ((a, "__a"), (b, "__b")))
    state = F.when(F.col("__a").isNull(), "only_b").when(F.col("__b").isNull(), "only_a").otherwise("both")
    return left.join(right, key, "full").select(key, state.alias("state"))


def value_counts(df: DataFrame, column: str, none: str = "(none)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(none)).alias(column)).agg(F.count("*").alias("n"))


def share_of_total(counts: DataFrame, by: list[str] = (), digits: int = 3) -> DataFrame:
    """counts (with n) with pct: percent of the total, or of the total of its group."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, digits))


def drop_at_ranks(df: DataFrame, order: list[Column], ranks: list[int], by: list[str]) -> DataFrame:
    """Rows ranked per group, some ranks left out, and the rest numbered anew as `rank`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(~F.col("__r").isin(ranks)).drop("__r").withColumn("rank", F.row_number().over(w))
