"""Document quality by hierarchical empirical Bayes.

A logistic classifier of a text's make-up (shares of kinds of characters, repetition, lengths) gives each
document a probability of being good. It is fitted on at most `max_docs` labelled documents, those of least
hashed id. Then a document is judged in view of its site: its host's posterior is the mean probability of
the host's other documents, shrunk towards the mean of all documents, and its path's posterior that of the
path's other documents, shrunk towards the host's. How strongly follows from the data by the method of
moments: the less hosts (paths of a host) differ beyond chance, the stronger. The path's posterior replaces
the overall mean as prior in the document's odds.

Sums are of integers, so results don't depend on the order of addition. Hosts and paths are counted by
partial aggregation and joined back as tables; Spark splits what one very large host is joined with.

Edge cases: null and empty texts have a make-up of zeros and are judged by it and their site. A null host or
path is a host or path of its own. A null id or label trains nothing; contradicting labels of one id count as bad. Without labelled documents of both kinds every document is good with
their share, or 1/2 without any. Repeated rows are judged alike. Empty tables give no rows; other columns are ignored by
`quality` and kept by `without_rejected`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, type_of

MICRO = 1_000_000
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*+=^~_@", b"()[]{}<>/\\\"'`-", b"\n", bytes(range(128, 256))]
_KIND = np.full(256, len(_KINDS))
for _i, _of in enumerate(_KINDS):
    _KIND[list(_of)] = _i
N_FEATURES = len(_KINDS) + 6


def make_up(text: bytes) -> list[float]:
    """The features of a text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    counts = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=len(_KINDS) + 1)[: len(_KINDS)]
    inside = sum(map(len, words))
    n = len(words)
    upper, lower = counts[:2]
    lines = text.split(b"\n")
    return [
        *(counts / inside).tolist(),
        upper / max(1, upper + lower),
        len(set(words)) / n,
        len(set(words)) / n**0.7,
        len(set(lines)) / len(lines),
        inside / n,
        float(np.log1p(n)),
    ]


def fit(x: np.ndarray, y: np.ndarray, hold: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (intercept first) of a logistic regression held to zero, by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [hold] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        step *= min(1, 4 / np.abs(step).max())
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def evidence(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, host: Column, path: Column, max_docs: int) -> DataFrame:
    """A table: id, text_key, host, path, p (probability of being good in view of the text, in millionths)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id).limit(max_docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make_up(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    train = docs.select(doc_id, F.col(text).cast("binary").alias("text")).join(F.broadcast(picked), doc_id).select("label", "text")
    found = sorted(tuple(r) for r in train.mapInArrow(features, "label int, x array<double>").collect())  # max_docs rows, more only for repeated ones
    y = np.array([r[0] for r in found], float)
    if 0 < y.sum() < len(y):
        mean, scale, beta = fit(np.array([r[1] for r in found]), y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        mean, scale, beta = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([np.log(share / (1 - share))] + [0.0] * N_FEATURES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([make_up(t or b"") for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(beta[0] + np.clip((x - mean) / scale, -8, 8) @ beta[1:], -30, 30)))
            p = pa.array(np.clip(np.rint(p * MICRO), 1, MICRO - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text_key", "host", "path")), p], ["id", "text_key", "host", "path", "p"])

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).cast("binary").alias("text"))
    return saved(rows.mapInArrow(judge, f"id {type_of(docs, doc_id)}, text_key long, host string, path string, p long"), "evidence")


def strength(groups: DataFrame, mean: Column, least: float = 1.0, most: float = 1e6) -> float:
    """How many documents the prior `mean` weighs, from groups (n, s: documents and sum of p in millionths)."""
    m = mean / MICRO
    apart = F.sum(F.col("n") * (F.col("s") / F.col("n") / MICRO - m) ** 2)
    row = groups.where("n > 1").agg(apart.alias("apart"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("spread"), F.sum("n").alias("n")).first()
    if not row.n:
        return most
    beyond = row.apart - row.chance  # of groups that differ by chance alone, the squares have this expectation
    return float(min(most, max(least, row.spread / beyond - 1))) if beyond > 0 else most


def quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    host: Column,
    path: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_docs: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """doc_id, text_key, evidence (by the text alone), site_prior, score, keep of every document."""
    rows = evidence(docs, labels, doc_id=doc_id, text=text, label=label, host=host, path=path, max_docs=max_docs)
    paths = saved(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("host_s") / F.sum("host_n"), F.lit(MICRO / 2)).alias("mean")).first()["mean"]
    k_host = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), F.lit(total))
    of_host = lambda n, s: (s + k_host * F.lit(total)) / (n + k_host)
    sites = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).select(paths.host, "path", "n", "s", "host_n", "host_s")
    sites = saved(sites, "sites")
    k_path = strength(sites.select("n", "s", of_host(F.col("host_n"), F.col("host_s")).alias("m")), F.col("m"))
    own = rows.join(sites, rows.host.eqNullSafe(sites.host) & rows.path.eqNullSafe(sites.path)).select("id", "text_key", "p", "n", "s", "host_n", "host_s")
    p = F.col("p")
    prior = (F.col("s") - p + k_path * of_host(F.col("host_n") - 1, F.col("host_s") - p)) / (F.col("n") - 1 + k_path) / MICRO
    odds = lambda x: F.log(x / (1 - x))
    logit = odds(p / MICRO) + odds(F.col("site_prior")) - F.lit(float(np.log(total / (MICRO - total))))
    out = own.withColumn("site_prior", prior).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select(F.col("id").alias(doc_id), "text_key", (p / MICRO).alias("evidence"), "site_prior", "score", (F.col("score") >= threshold).alias("keep"))


def without_rejected(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that `quality` keeps."""
    bad = quality(docs, labels, doc_id=doc_id, text=text, **options).where("NOT keep")
    bad = bad.select(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key")), "left_anti")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), host=F.col("source"), path=F.concat_ws("/", "source", "lang")
    )
    return found.drop("text_key")
