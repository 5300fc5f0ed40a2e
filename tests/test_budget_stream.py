import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.sources.files import shared_folder
from geoloom.streaming import budget

SCHEMA = "ts timestamp, id long, who string, cost double"


def entries(spark, lo, hi, far=False):
    rows = spark.range(lo, hi).select(
        (F.timestamp_seconds(F.lit(1_600_000_000) + F.floor(F.col("id") / 3) * 60 + (F.col("id") * 7919) % 50)).alias("ts"), "id", F.concat(F.lit("w"), F.col("id") % 4).alias("who"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("double")).alias("cost"),
    )
    end = spark.createDataFrame([(-1, 0)], "id long, x int").select(F.timestamp_seconds(F.lit(1_900_000_000)).alias("ts"), "id", F.lit("end").alias("who"), F.lit(0.0).alias("cost"))
    return rows.unionByName(end) if far else rows


def batch(rows, cap):
    w = Window.partitionBy("who").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    c = F.coalesce("cost", F.lit(0.0))
    out = rows.withColumn("before", F.coalesce(F.sum(c).over(w), F.lit(0.0))).where(F.col("before") < cap)
    return sorted((r.who, r.id, r.before) for r in out.collect())


def test_equals_the_batch_after_a_restart(spark):
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    source, out, checkpoint = f"{root}/in", f"{root}/out", f"{root}/state"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        kept = budget.budgeted(stream, key=F.col("who"), ts="ts", entry_id="id", cost=F.col("cost"), cap=40, late="10 minutes")
        return budget.append_to(kept, out, checkpoint)

    # files overlap in time, within the allowed lateness
    whole = entries(spark, 0, 400)
    for k, (lo, hi) in enumerate(((0, 110), (90, 210))):
        entries(spark, lo, hi).where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(source)
    first = run().count()
    seen = entries(spark, 0, 110).where("id % 2 = 0").unionByName(entries(spark, 90, 210).where("id % 2 = 1"))
    more = entries(spark, 205, 400, far=True)
    more.coalesce(1).write.mode("append").parquet(source)
    got = sorted((r.k, r.id, r.spent_before) for r in run().collect() if r.k != "end")
    want = batch(seen.unionByName(more.where("id >= 0")), 40)
    assert 0 < first <= len(got) and got == want
    assert whole.count() == 400 and len(want) < 400


def test_late_entries_and_nulls(spark):
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = [("2024-01-01 00:00:00", 1, "a", 5.0), ("2024-01-01 00:00:00", 0, "a", None), (None, 3, "a", 1.0), ("2024-01-01 02:00:00", 4, "a", 1.0)]
    as_rows = lambda rs: spark.createDataFrame(rs, "ts string, id long, who string, cost double").withColumn("ts", F.col("ts").cast("timestamp"))
    as_rows(rows).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        return budget.append_to(budget.budgeted(stream, key=F.col("who"), ts="ts", entry_id="id", cost=F.col("cost"), cap=6, late="10 minutes"), f"{root}/out", f"{root}/state").orderBy("ts", "id").collect()

    assert [(r.id, r.spent_before) for r in run()] == [(0, 0.0), (1, 0.0)]
    late = [("2024-01-01 00:30:00", 5, "a", 9.0), ("2024-01-01 01:59:00", 6, "a", 0.5), ("2025-01-01 00:00:00", 7, "b", 0.0)]
    as_rows(late).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert [(r.id, r.spent_before) for r in run() if r.k == "a"] == [(0, 0.0), (1, 0.0), (6, 5.0), (4, 5.5)]


def test_what_cannot_be_paid_does_not_wait(spark):
    import random

    entries = [(t, i, random.Random(i).choice([0.0, 0.1, 1.0])) for i, t in enumerate(random.Random(3).choices(range(50), k=400))]
    kept = budget._affordable(random.Random(1).sample(entries, 400), 0.5, 6.0)
    spent, want = 0.5, []
    for e in sorted(entries):
        if spent < 6.0:
            want.append(e)
        spent += e[2]
    assert kept == want and len(want) < 60
    assert budget._affordable(entries, 6.0, 6.0) == []
