"""Geography tables derived from the star schema's tables, as SQL that Spark and DuckDB both read.

Shapes are boxes and points at places that follow from keys, so either engine can compute what is expected.
In the texts `{name}` is a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import box

_FOUR = "(VALUES (0), (1), (2), (3)) AS {0}({0})"

SQL = {
    # a grid of counties of 0.3 by 0.12 degrees
    "counties": """
SELECT n_nationkey AS county, concat('72', lpad(CAST(2 * n_nationkey + 1 AS STRING), 3, '0')) AS geoid, n_name AS name,
  3e-1 * (n_nationkey % 5) - 6.75e1 AS minx, 1.2e-1 * FLOOR(n_nationkey / 5) + 1.79e1 AS miny,
  3e-1 * (n_nationkey % 5 + 1) - 6.75e1 AS maxx, 1.2e-1 * (FLOOR(n_nationkey / 5) + 1) + 1.79e1 AS maxy
FROM {nation}""",
    # every supplier is a tract of four block groups, side by side in its county
    "block_groups": f"""
SELECT c.geoid AS county_geoid, concat(c.geoid, lpad(CAST(t AS STRING), 6, '0'), CAST(b AS STRING)) AS geoid, s_suppkey * 4 + b AS id,
  c.minx + w * t AS minx, c.miny + 3e-2 * b AS miny, c.minx + w * (t + 1) AS maxx, c.miny + 3e-2 * (b + 1) AS maxy,
  CAST(1000 + (s_suppkey * 4 + b) % 37 AS DOUBLE) AS land_m2
FROM (SELECT s_suppkey, s_suppkey % 25 AS n, CAST(FLOOR(s_suppkey / 25) AS BIGINT) AS t, 3e-1 / (SELECT CEIL((max(s_suppkey) + 1) / 25) FROM {{supplier}}) AS w FROM {{supplier}}) s
JOIN {{counties}} c ON c.county = s.n CROSS JOIN {_FOUR.format("b")}""",
    "buildings": """
SELECT c_custkey AS building_id, x AS lon, y AS lat, x - w AS minx, y - w AS miny, x + w AS maxx, y + w AS maxy, c_mktsegment AS class, c_acctbal AS height
FROM (
  SELECT c_custkey, c_mktsegment, c_acctbal, 1.5e0 * ((c_custkey * 7919) % 100003) / 100003 - 6.75e1 AS x, 6e-1 * ((c_custkey * 104729) % 100019) / 100019 + 1.79e1 AS y, (5 + c_custkey % 7) * 1e-5 AS w
  FROM {customer})""",
    "panels": """
SELECT p_partkey AS panel_id, b.lon + (p_partkey % 5) * 2e-5 - 2e-5 AS minx, b.lat - 2e-5 AS miny, b.lon + (p_partkey % 5) * 2e-5 + 2e-5 AS maxx, b.lat + 2e-5 AS maxy, kind, size
FROM (SELECT p_partkey, p_type AS kind, p_size AS size, (p_partkey * 3) % (SELECT count(*) FROM {customer}) AS at FROM {part}) p JOIN {buildings} b ON b.building_id = p.at""",
    "acs": """
SELECT geoid AS bg_geoid, id,
  CASE WHEN id % 37 = 0 THEN '-666666666' WHEN id % 41 = 0 THEN 'x' ELSE CAST(100 + id % 50 AS STRING) END AS g1,
  CAST(50 + id % 30 AS STRING) AS g2, CAST(id % 20 AS STRING) AS g3,
  CASE WHEN id % 43 = 0 THEN '0' ELSE CAST(150 + id % 50 + id % 30 + id % 20 AS STRING) END AS total,
  CAST(id % 90 AS STRING) AS owners, CAST(100 + id % 11 AS STRING) AS households, CAST(400 + id % 100 AS DOUBLE) AS population
FROM {block_groups}""",
    "blocks": """
SELECT concat(geoid, lpad(CAST(k AS STRING), 3, '0')) AS block_geoid, id * 8 + k AS id, CAST(20 + (id * 8 + k) % 60 + CASE WHEN id % 29 = 0 THEN 200 ELSE 0 END AS BIGINT) AS pop,
  CAST(5 + (id * 8 + k) % 9 AS BIGINT) AS housing, CAST(50 + (id * 8 + k) % 40 AS DOUBLE) AS land_m2,
  minx, miny + 3.75e-3 * k AS miny, maxx, miny + 3.75e-3 * (k + 1) AS maxy
FROM {block_groups} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS k(k)""",
    "blocks_later": """
SELECT CASE WHEN id % 99 = 98 THEN concat(block_geoid, 'n') ELSE block_geoid END AS geoid, minx, miny,
  CASE WHEN id % 53 = 0 THEN maxx - 5e-2 * (maxx - minx) WHEN id % 31 = 0 THEN maxx - 1e-4 * (maxx - minx) ELSE maxx END AS maxx, maxy
FROM {blocks} WHERE id % 97 <> 0""",
    "pixels": """
SELECT CAST(l_partkey % 64 AS BIGINT) AS tile_id, l_suppkey AS zone,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) END AS value
FROM {lineitem}""",
    "ledger": """
SELECT ts, event_id, user_id AS tile_id, CASE WHEN event_type IN ('click', 'view') THEN 'layers' ELSE 'other' END AS endpoint,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'not_found' ELSE 'ok' END AS status, event_id % 2 = 0 AS cache_hit
FROM {events}""",
    "capacity": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, SUM(CAST(o_totalprice AS DECIMAL(20, 2))) AS kw, COUNT(DISTINCT o_custkey) AS client_count
FROM {orders} GROUP BY 1""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the schema, or one derived from it."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {n: fixture(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", SQL[name]))}
    return spark.sql(SQL[name], **used)


def expanded(sql: str) -> str:
    """DuckDB SQL with every `{fixture}` replaced by its text."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in BASE else f"({expanded(SQL[m[1]])})", sql)


def with_box(df: DataFrame) -> DataFrame:
    """df with its box as geometry."""
    return df.withColumn("geom", box(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))))
