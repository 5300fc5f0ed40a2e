import pytest
from pyspark.sql import functions as F

from geoloom.llm import quality as op


def test_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op.op5_quality(spark, d).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def brute(p, hosts, paths, k_host, k_path):
    total = sum(p) / len(p)
    out = []
    for i, x in enumerate(p):
        own_h = [y for j, y in enumerate(p) if j != i and hosts[j] == hosts[i]]
        own_p = [y for j, y in enumerate(p) if j != i and (hosts[j], paths[j]) == (hosts[i], paths[i])]
        h = (sum(own_h) + k_host * total) / (len(own_h) + k_host)
        prior = (sum(own_p) + k_path * h) / (len(own_p) + k_path)
        odds = x / (1 - x) * prior / (1 - prior) / (total / (1 - total))
        out.append((prior, odds / (1 + odds)))
    return out


def test_shrinkage(spark, monkeypatch):
    strengths = iter([7.0, 3.0])
    monkeypatch.setattr(op, "strength", lambda *a, **b: next(strengths))
    good, bad = "Plain words that tell a story of some length, and more. " * 3, "BUY!! NOW!! CHEAP!! " * 10
    texts = [(i, (good if i % 5 else bad) + str(i), "h" if i % 3 else None, f"p{i % 2}") for i in range(40)]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, source string, lang string, p int")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = sorted(op.quality(docs, labels, host=F.col("source"), path=F.col("lang")).collect(), key=lambda r: r.doc_id)
    want = brute([r.evidence for r in rows], [t[2] for t in texts], [t[3] for t in texts], 7.0, 3.0)
    for r, (prior, score) in zip(rows, want):
        assert r.site_prior == pytest.approx(prior) and r.score == pytest.approx(score)
    assert [r.keep for r in rows] == [bool(i % 5) for i in range(40)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "a", "x"), (2, "", "a", "x"), (None, "some text", "a", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    at = {"host": F.col("source"), "path": F.col("lang")}
    rows = op.quality(docs, labels, **at).collect()
    assert len(rows) == 4 and all(r.keep for r in rows)
    assert op.without_rejected(docs, labels, **at).columns == docs.columns
    assert op.quality(docs.limit(0), labels, **at).count() == 0


def test_strength_follows_the_data(spark):
    alike = spark.createDataFrame([(100, 50_000_000)] * 20, "n long, s long")
    apart = spark.createDataFrame([(100, 5_000_000), (100, 95_000_000)] * 10, "n long, s long")
    m = F.lit(500_000.0)
    assert op.strength(alike, m) == 1e6 and op.strength(apart, m) < 2


def test_strength_against_the_formula(spark):
    import random

    rng = random.Random(8)
    groups = [(n := rng.randrange(1, 50), rng.randrange(n * 1_000_000)) for _ in range(60)]
    mean = 400_000.0
    m, used = mean / 1e6, [(n, s) for n, s in groups if n > 1]
    apart = sum(n * (s / n / 1e6 - m) ** 2 for n, s in used)
    chance, spread = len(used) * m * (1 - m), sum(n * m * (1 - m) for n, _ in used)
    want = min(1e6, max(1.0, spread / (apart - chance) - 1))
    assert op.strength(spark.createDataFrame(groups, "n long, s long"), F.lit(mean)) == pytest.approx(want)
