"""SimHash near-duplicates: 64-bit fingerprints that differ in at most two bits are linked, and links chained.

Candidates are found by pigeonring filtering. A fingerprint is a ring of `segments` equal segments. If two
fingerprints differ in at most DISTANCE bits, then from some segment on every chain of l consecutive
segments differs in at most l * DISTANCE / segments bits. For short chains that is no bit at all: each
fingerprint goes, once per starting segment, into the bucket of that chain, and two of one bucket are
compared chain by chain, the last chain being the whole ring, the full check.

A bucket with more than `pairwise` fingerprints isn't compared pair by pair: each of its fingerprints is
listed under itself and under every fingerprint one bit away, and those that meet under one are linked to
the smallest there. Two fingerprints meet exactly if they differ in at most two bits, so no link is lost
and the rows grow with the bucket, not with its square.

Only distinct fingerprints take part, so a group of copies of any size is one of them.

Edge cases: null and empty texts have fingerprint zero and are linked as any other. Repeated rows get the
same component. A null id is never a component's id unless all its documents have none. Empty tables give
no rows; columns other than id and text are ignored by `near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import saved, type_of
from .components import components

DISTANCE = 2
_LOW_BITS = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `size` words, A-Z lower-cased, joined by blanks; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[:n].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end[-n:].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    runs = np.arange(0, len(hashes), 255)  # a byte counts up to 255
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LOW_BITS, runs)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id, text_key (xxhash64 of the text), fingerprint as a long of the same bits."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(shingle_hashes(t or b"", shingle)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(prints.view(np.int64))], ["id", "text_key", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(of_batch, f"id {type_of(docs, doc_id)}, text_key long, fingerprint long")


def links(prints: DataFrame, *, segments: int = 8, pairwise: int = 128) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints that differ in at most DISTANCE bits."""
    width = 64 // segments
    if width * segments != 64 or segments <= DISTANCE:
        raise ValueError("segments must divide 64 and exceed the distance")
    equal = -(-segments // DISTANCE) - 1  # segments of the longest chain in which no bit may differ
    turned = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i).alias("start"),
                    (F.shiftrightunsigned("fingerprint", i * width).bitwiseOR(F.shiftleft("fingerprint", 64 - i * width)) if i else F.col("fingerprint")).alias("ring"),
                )
                for i in range(segments)
            )
        )
    )
    chain = F.col("ring").bitwiseAND(F.lit((1 << equal * width) - 1))
    spread = prints.select("fingerprint").distinct().select("fingerprint", turned.alias("t")).select("fingerprint", "t.*").withColumn("chain", chain)
    spread = saved(spread, "chains")
    heavy = spread.groupBy("start", "chain").count().where(F.col("count") > pairwise).select("start", "chain")

    def within(a: Column, b: Column) -> Column:
        apart = a.bitwiseXOR(b)
        tests = [F.bit_count(apart.bitwiseAND(F.lit((1 << n * width) - 1)) if n < segments else apart) <= n * DISTANCE // segments for n in range(equal + 1, segments + 1)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    light = spread.join(heavy, ["start", "chain"], "left_anti")
    a, b = light.alias("a"), light.alias("b")
    same = (F.col("a.start") == F.col("b.start")) & (F.col("a.chain") == F.col("b.chain"))
    pairs = a.join(b, same & (F.col("a.fingerprint") < F.col("b.fingerprint")) & within(F.col("a.ring"), F.col("b.ring")))
    pairs = pairs.select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))

    free = [F.lit(0)] + [F.lit(1 << bit if bit < 63 else -(1 << 63)) for bit in range(equal * width, 64)]
    near = spread.join(heavy, ["start", "chain"], "left_semi").select(
        "start", "fingerprint", F.col("ring"), F.explode(F.array(*(f.cast("long") for f in free))).alias("flip")
    )
    meet = near.withColumn("ring", F.col("ring").bitwiseXOR(F.col("flip")))
    least = meet.groupBy("start", "ring").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = meet.join(least, ["start", "ring"]).where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, segments: int = 8, pairwise: int = 128, similar: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, text_key, fingerprint (long), component_id, the smallest id of its component.

    similar: further links (a, b), as text keys.
    """
    prints = saved(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    groups = prints.groupBy("fingerprint").agg(F.min("id").alias("least_id"))
    linked_prints = links(prints, segments=segments, pairwise=pairwise)
    if similar is not None:
        of_key = prints.select("text_key", "fingerprint").distinct()
        a, b = (of_key.select(F.col("text_key").alias(c), F.col("fingerprint").alias(f"print_{c}")) for c in ("a", "b"))
        linked_prints = linked_prints.union(similar.join(a, "a").join(b, "b").select("print_a", "print_b"))
    labels = components(linked_prints).withColumnRenamed("node", "fingerprint")
    linked = labels.join(groups, "fingerprint")
    roots = linked.groupBy("root").agg(F.min("least_id").alias("root_id"))
    known = linked.join(roots, "root").select("fingerprint", "root_id")
    of_print = groups.join(known, "fingerprint", "left").select("fingerprint", F.coalesce("root_id", "least_id").alias("component_id"))
    return prints.join(of_print, "fingerprint").select(F.col("id").alias(doc_id), "text_key", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a row that comes first (by id, null last, then text_key).

    Rows that repeat id and text of the one that stays go as well.
    """
    found = saved(near_duplicates(docs, doc_id=doc_id, text=text, **options), "duplicates")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "text_key")
    # without an id of its own, a component is known by its fingerprint
    part = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint"))]
    first = found.groupBy(*(c.alias(n) for c, n in zip(part, ("c", "f")))).agg(F.min(order).alias("first"))
    rows = found.select(order.alias("own"), *(c.alias(n) for c, n in zip(part, ("c", "f"))))
    same = rows.c.eqNullSafe(first.c) & rows.f.eqNullSafe(first.f)
    gone = rows.join(first, same & (rows.own != first["first"])).select(F.col("own.id").alias("__id"), F.col("own.text_key").alias("__key")).distinct()
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key"))
    kept = docs.join(gone, on, "left_anti")
    twice = found.groupBy(doc_id, "text_key").count().where("count > 1").select(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key"))
    if twice.isEmpty():
        return kept
    return kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates([doc_id, text]))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
