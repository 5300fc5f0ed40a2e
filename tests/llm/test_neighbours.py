import functools

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import neighbours as op


def test_sql(spark, data, same):
    same(op.op7_nearest(spark, data), op.OP7_SQL)


def test_blocks_and_recall(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)) * rng.uniform(0.1, 5, (1500, 1))
    v[200:400] = v[200]  # many equal vectors: ties by id
    df = spark.createDataFrame([(i, x.tolist(), 0.0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, norm double")
    rows = op.nearest(df, F.col("id") % 50 == 0, k=10, query_block=8, block=256).collect()
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    hits = 0
    for q in range(0, 1500, 50):
        want = sorted(range(1500), key=lambda j: (-round(s[q, j], 9), j))[:10]
        got = [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        assert len(got) == 10 and q not in got
        hits += len(set(want) & set(got))
    assert hits / 300 >= 0.99


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (21, [3.0, 3.0]), (21, [3.0, 3.0]), (22, [1e-30, 1e-30])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in op.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 21, 3.0), (0, 2, 22, 1e-30), (0, 3, 20, 0.0), (20, 1, 21, 6.0), (20, 2, 22, 2e-30), (20, 3, 0, 0.0)]
    assert op.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_magnitudes(spark):
    base = [[1.0, 2.0, 3.0], [-1.0, 0.5, 2.0], [0.0, 1.0, 0.0], [2.0, 2.0, -1.0], [-3.0, 1.0, 1.0]]
    for scale in (1e-100, 1e-20, 1.0, 1e20, 1e37, 1e100):
        df = spark.createDataFrame([(i, [x * scale for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
        rows = op.nearest(df, F.lit(True), k=20).collect()
        assert len(rows) == 20
        for q in range(5):
            added = lambda j: functools.reduce(lambda total, xy: total + xy[0] * scale * (xy[1] * scale), zip(base[q], base[j]), 0.0)
            want = sorted(((added(j), -j) for j in range(5) if j != q), reverse=True)
            got = [(r.score, -r.vec_id) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
            assert got == want


def test_products_beyond_the_range(spark):
    rng = np.random.default_rng(8)
    v = rng.uniform(0.5, 1, (60, 4)) * np.where(np.arange(60) % 3 == 0, 1e160, 1.0)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = op.nearest(df, F.col("id") % 20 == 0, k=10).collect()
    assert len(rows) == 30
    with np.errstate(over="ignore"):
        s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    for q in (0, 20, 40):
        got = [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        assert got == np.lexsort((np.arange(60), -s[q]))[:10].tolist()


def test_one_large_vector_among_small_ones(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((400, 16))
    v[7] *= 1e90
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    rows = op.nearest(df, F.col("id") % 40 == 0, k=10).collect()
    for q in range(0, 400, 40):
        got = [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        assert got == np.argsort(-s[q])[:10].tolist()


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL")
    table = {r.vec_id: r.embedding for r in df.collect() if None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    ids = np.array(sorted(table))
    v = np.array([table[i] for i in ids])
    found: dict[int, set[int]] = {}
    for r in op.op7_nearest(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = n = 0
    for at, i in enumerate(ids):
        if i % 20 == 0:
            s = v @ v[at]
            s[at] = -np.inf
            want = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
            hits, n = hits + len(want & found[i]), n + len(want)
    assert hits >= 0.99 * n
