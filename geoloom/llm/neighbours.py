"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index, for every vector: it is scaled to length one and turned by one random rotation; kept are the signs
of the result, packed to bits, the vector's norm, and the cosine between the turned vector and its signs.
The inner product of the signs with a turned query, divided by that cosine, estimates the inner product
without bias, and the error is normal-like with a deviation that follows from the cosine alone.

Search: queries and candidates are dealt into blocks of bounded size, and each pair of blocks is a group of
a co-grouping. In it, one matrix product over the bits gives each query's estimates plus `sigmas` deviations.
A few times k of the best are scored exactly, which gives a score that k candidates reach, and every
candidate whose bound reaches it is scored exactly as well. Each pair of blocks gives k rows per query; the
best k of these are the result. Estimates are of vectors scaled to the block's largest norm and compared with
a tolerance, so very large or small components lose no candidate.

Edge cases: a vector that is null, zero, or holds a null or non-finite component takes no part, nor does
one without an id or of another length than the most common one (of equally common ones the longest), which
has no inner product with the others. Of
rows that share an id, the least vector counts. With fewer candidates than k, all are returned. Equal
scores rank by id; products beyond the range of doubles are infinite, and equal as such. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A list column without nulls as doubles, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """The vectors that take part (id, vector), and their length."""
    rows = table.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return (rows.where(F.size("vector") == sizes["size"]), sizes["size"]) if sizes else (rows, 0)


def one_bit_index(rows: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """id, vector, code (packed signs), norm, cosine."""
    turn = rotation(size, seed)

    def encode(batches):
        for batch in batches:
            v = matrix(batch.column("vector"), size)
            scale = np.abs(v).max(axis=1, keepdims=True)
            norm = np.sqrt(((v / scale) ** 2).sum(1)) * scale[:, 0]
            turned = (v / scale) @ turn / (norm / scale[:, 0])[:, None]
            codes = np.packbits(turned > 0, axis=1)
            cosine = np.abs(turned).sum(1) / np.sqrt(size)
            out = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays(out, ["id", "vector", "code", "norm", "cosine"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, vector {kind}, code binary, norm double, cosine double")


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b (both given transposed), component by component in order."""
    total = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for x, y in zip(a, b):
            total += x[i] * y[j]
    return total


def bounds_of(block: pa.Table, size: int, sigmas: float) -> tuple[np.ndarray, float]:
    """A row per candidate whose product with (turned unit query, 1) is the estimate plus deviations, over the largest norm; and that norm."""
    packed = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(block), -1)
    norm, cosine = block.column("norm").to_numpy(), block.column("cosine").to_numpy()
    largest = float(norm.max())
    norm = norm / largest
    signs = np.unpackbits(packed, axis=1)[:, :size].astype(np.float32) * 2 - 1
    deviation = norm * np.sqrt(np.maximum(1 / cosine**2 - 1, 0) / max(size - 1, 1)) * sigmas
    return np.hstack([signs * (norm / cosine / np.sqrt(size)).astype(np.float32)[:, None], deviation.astype(np.float32)[:, None]]), largest


def some_of_best(bound: np.ndarray, few: int, width: int = 16) -> np.ndarray:
    """For each row the columns of `few` large values: of the largest values of runs of `width` columns the largest."""
    n = bound.shape[1] // width
    if n < few:
        return np.argpartition(-bound, few - 1, axis=1)[:, :few]
    run = bound[:, : n * width].reshape(len(bound), n, width)
    best = np.argpartition(-run.max(2), few - 1, axis=1)[:, :few]
    return best * width + np.take_along_axis(run, best[:, :, None], 1).argmax(2)


def products(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 20_000) -> np.ndarray:
    """Inner products of rows i of q with rows j of v, in any order of addition."""
    with np.errstate(over="ignore", invalid="ignore"):
        parts = [np.einsum("ij,ij->i", q[i[a : a + at_once]], v[j[a : a + at_once]]) for a in range(0, len(i), at_once)]
    return np.concatenate([np.zeros(0), *parts])


def best_of_block(queries: pa.Table, block: pa.Table, size: int, k: int, turn: np.ndarray, sigmas: float, at_once: int = 64) -> pa.Table:
    """The k best of a block for each query, with exact scores."""
    ids, q_ids = block.column("id").to_numpy(), queries.column("id").to_numpy()
    v, q = matrix(block.column("vector"), size), matrix(queries.column("vector"), size)
    bounds, largest = bounds_of(block, size, sigmas)
    q_norm = queries.column("norm").to_numpy()
    turned = np.hstack([(q / q_norm[:, None]) @ turn, np.ones((len(q), 1))]).astype(np.float32)
    by_id = np.argsort(ids)
    own = by_id[np.minimum(np.searchsorted(ids, q_ids, sorter=by_id), len(ids) - 1)]
    has_own = ids[own] == q_ids
    few = min(3 * k, len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), at_once):
        some = slice(at, at + at_once)
        bound = turned[some] @ bounds.T
        every = np.arange(len(bound))
        mine = every[has_own[some]], own[some][has_own[some]]
        bound[mine] = -np.inf
        first = some_of_best(bound, few)
        score = products(q[some], v, np.repeat(every, few), first.ravel()).reshape(-1, few)
        score[np.isneginf(np.take_along_axis(bound, first, 1))] = -np.inf
        bar = np.sort(score, axis=1)[:, -k] if few >= k else np.full(len(bound), -np.inf)
        np.put_along_axis(bound, first, np.inf, 1)
        bound[mine] = -np.inf
        with np.errstate(over="ignore", invalid="ignore"):
            unit = largest * q_norm[some]
            known = np.isfinite(bar) & np.isfinite(unit)  # else products leave the range of doubles, and all are scored
            chosen = (bound >= np.where(known, bar / unit - 1e-5, -1e30).astype(np.float32)[:, None]) | ~known[:, None] & ~np.isneginf(bound)
            least = np.where(known, bar - 1e-12 * np.abs(bar) - 1e-12 * unit, -np.inf)
        if np.count_nonzero(chosen) * 16 > chosen.size:  # one product of all costs less than picking so many rows
            with np.errstate(over="ignore", invalid="ignore"):
                chosen &= ~(q[some] @ v.T < least[:, None])
            row, col = np.divmod(np.flatnonzero(chosen), len(ids))
        else:
            row, col = np.divmod(np.flatnonzero(chosen), len(ids))
            near = ~(products(q[some], v, row, col) < least[row])
            row, col = row[near], col[near]
        score = exact_scores(q[some].T, v.T, row, col)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((q_ids[some][row[keep]], ids[col[keep]], score[keep]))
    query, vec, score = (np.concatenate([o[i] for o in out]) for i in range(3))
    return pa.table({"query_id": pa.array(query, queries.schema.field("id").type), "vec_id": pa.array(vec, block.schema.field("id").type), "score": score})


def nearest(
    table: DataFrame,
    query: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    sigmas: float = 3.5,
    seed: int = 7,
    query_block: int = 1024,
    block: int = 16384,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every vector of table for whose id `query` (on a column named id) holds, the k others of largest inner product."""
    rows, size = vectors(table, vec_id, embedding)
    index = saved(one_bit_index(rows, size, seed), "codes")
    n, n_queries = index.agg(F.count("*"), F.count(F.when(query, 1))).first()
    q_blocks, blocks = max(1, -(-n_queries // query_block)), max(1, -(-n // block))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    queries = index.where(query).select("id", "vector", "norm", deal(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    candidates = index.withColumn("cb", deal(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    kind = table.schema[vec_id].dataType.simpleString()
    turn = rotation(size, seed) if size else None

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": left.column("id")[:0], "vec_id": right.column("id")[:0], "score": pa.array([], pa.float64())})
        return best_of_block(left, right, size, k, turn, sigmas)

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 20
"""
