"""Monthly series from raw cell grids, quarters, growth; scores of example sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_tokens, normal_label, quarter_columns


def grid_records(cells: DataFrame, *, period: list[str], capacity: list[str], clients: list[str]) -> DataFrame:
    """Records from a sheet's cells (row, col, value), whose header is the first row with all three labels, given by tokens.

    Rows without a period on the first of a month or with a negative or missing capacity go.
    """
    label = cells.where("value IS NOT NULL").withColumn("label", normal_label(F.col("value")))
    wanted = {"period": period, "capacity": capacity, "clients": clients}
    marks = {k: F.min(F.when(has_tokens(F.col("label"), t), F.col("col"))).alias(k) for k, t in wanted.items()}
    head = label.groupBy("row").agg(*marks.values()).where("period IS NOT NULL AND capacity IS NOT NULL AND clients IS NOT NULL")
    head = head.orderBy("row").limit(1).select(F.col("row").alias("head"), *(F.col(k).alias(f"c_{k}") for k in wanted))
    body = cells.join(F.broadcast(head)).where("row > head")
    value = lambda k: F.max(F.when(F.col("col") == F.col(f"c_{k}"), F.col("value"))).alias(k)
    rows = body.groupBy("row").agg(*map(value, wanted))
    rows = rows.select(F.col("period").try_cast("date").alias("period"), F.col("capacity").try_cast("double").alias("capacity_kw"), F.col("clients").try_cast("double").cast("long").alias("client_count"))
    return rows.where("period IS NOT NULL AND day(period) = 1 AND capacity_kw >= 0").withColumn("capacity_mw", F.col("capacity_kw") / 1000)


def sheet_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"), F.count("value").alias("filled"))


def sheet_report(cells: DataFrame, *, period: list[str], capacity: list[str], clients: list[str], period_col: int = 1, first: int = 12) -> DataFrame:
    """Per sheet: rows, columns, the row that holds all three labels first (null without one), its first labels, and the least and greatest date in the column of periods."""
    label = cells.where("value IS NOT NULL").withColumn("label", normal_label(F.col("value")))
    marks = [F.max(has_tokens(F.col("label"), t)).alias(k) for k, t in (("p", period), ("c", capacity), ("n", clients))]
    head = label.groupBy("sheet", "row").agg(*marks).where("p AND c AND n").groupBy("sheet").agg(F.min("row").alias("header_row"))
    own = label.join(head, "sheet").where("row = header_row").select("sheet", "col", "label")
    labels = own.groupBy("sheet").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("col", "label"))), lambda x: x.label), 1, first).alias("labels"))
    dates = cells.where(F.col("col") == period_col).groupBy("sheet").agg(*(f(F.col("value").try_cast("date")).alias(f"period_{n}") for n, f in (("min", F.min), ("max", F.max))))
    out = sheet_summary(cells).join(head, "sheet", "left").join(labels, "sheet", "left").join(dates, "sheet", "left")
    return out.select("sheet", "rows", "columns", "filled", "header_row", "labels", "period_min", "period_max")


def quarterly(monthly: DataFrame, start: str | None = None, end: str | None = None, by: list[str] = ()) -> DataFrame:
    """The last month of each quarter, with quarter columns and changes to the quarter before; growth of 0 is null.

    A series has a row a month, so one series (or one group of `by`) is ordered as a whole.
    """
    rows = monthly.withColumns(quarter_columns(F.col("period")))
    for bound, keep in ((start, F.col("period") >= start), (end, F.col("period") <= end)):
        rows = rows.where(keep) if bound else rows
    last = F.row_number().over(Window.partitionBy(*by, "quarter_start").orderBy(F.desc("period")))
    rows = rows.withColumn("__n", last).where("__n = 1").drop("__n")
    w = Window.partitionBy(*by).orderBy("period")
    before = F.lag("capacity_mw").over(w)
    return rows.withColumns(
        {
            "capacity_delta_mw": F.col("capacity_mw") - before,
            "capacity_growth_pct": F.try_divide((F.col("capacity_mw") - before) * 100, F.nullif(before, F.lit(0.0))),
            "client_delta": F.col("client_count") - F.lag("client_count").over(w),
        }
    )


def growth(series: DataFrame, value: str) -> DataFrame:
    first, last = F.min_by(value, "period"), F.max_by(value, "period")
    return series.agg(first.alias("first"), last.alias("last"), (last - first).alias("added"), F.try_divide(last, F.nullif(first, F.lit(0.0))).alias("ratio"))


def example_score(rows: Column, cover_pct: Column, arrays: Column, ratio: Column, gsd_cm: Column, bonus: Column) -> Column:
    """Score of an example site, to three decimals: many panel rows, much cover, few arrays, a plain ratio of array to panel area, fine imagery. A null adds nothing.

    The numbers are the published score's fixed values.
    """
    at_most = lambda x, most: F.least(x, F.lit(float(most)))
    not_below_zero = lambda x: F.greatest(x, F.lit(0.0))
    terms = [
        at_most(rows / 28.0, 3.2),
        at_most(cover_pct / 12.0, 2.0),
        not_below_zero(F.lit(2.25) - not_below_zero(F.coalesce(arrays, F.lit(0)) - 1.0) * 0.55),
        not_below_zero(F.lit(1.6) - F.abs(ratio - 1.22) * 3.5),
        not_below_zero((F.lit(120.0) - gsd_cm) / 20.0),
        bonus,
    ]
    return F.round(sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0))), 3)
