"""Links between texts whose sets of word shingles have a Jaccard similarity of `least` or more.

Candidates are found by min-hashing: each of `bands` bands has the least values of `rows` hash functions over
a text's shingles, and texts that agree in a band meet. At a similarity of 0.8, the usual values miss a pair
with a probability of 3 in 100,000, and less above. Every candidate is then checked on the whole sets of
64-bit shingle hashes, so what is linked is similar.

In a band's bucket with more than `pairwise` texts not all pairs meet. First large groups are gathered: all texts are
compared with one, that of least hash, so that it tends to be the same in all bands; those not similar to it with
another one of theirs, and so on for a few rounds, or until a round gathers little. What links then are still
missing join texts of crowded buckets whose components differ, one of them apart from its bucket's first text. These
are found exactly, by prefix filtering: shingles are ordered by rarity among the texts concerned, and two texts of
similarity `least` share one of the first few (the longer text looks up its first |x| - least |x| + 1 shingles among the
first |x| - 2 least / (1 + least) |x| + 1 of shorter ones), at places that leave room for enough others. So texts that share
boilerplate, but less than it takes, don't meet, as what is common comes last. Pairs also need bitmaps, of the
parity of their shingles' hashes, that differ in no more bits than the sets may in shingles. No partner and no
candidate is left out.

Edge cases: null and empty texts have no shingles and no links; a text of fewer words than a shingle has is
one shingle. Copies of a text are one text. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .simhash import shingle_hashes


def factors(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n odd factors and n masks, one of each per hash function."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, (1 << 64) - 1, n, np.uint64) | np.uint64(1), rng.integers(0, (1 << 64) - 1, n, np.uint64)


def band_keys(hashes: np.ndarray, odd: np.ndarray, mask: np.ndarray, bands: int) -> np.ndarray:
    """One number per band, from the least values of its hash functions over all shingles."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = (hashes[i : i + 2048] ^ mask[:, None]) * odd[:, None]
        part ^= part >> np.uint64(32)
        least = np.minimum(least, (part * odd[::-1, None]).min(1))
    key = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, -1).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar_texts(docs: DataFrame, *, text: str = "text", shingle: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4, pairwise: int = 8, rounds: int = 6) -> DataFrame:
    """Edges (a, b), a < b: xxhash64 of two texts of similarity `least` or more."""
    odd, mask = factors(bands * rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, found = [], [], []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if len(hashes := np.unique(shingle_hashes(t or b"", shingle))):
                    keys.append(key), sizes.append(len(hashes)), found.append(band_keys(hashes, odd, mask, bands))
            cols = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "size", "bands"])

    texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).cast("binary").alias("text"))
    sketches = texts.mapInArrow(sketch, "key long, size long, bands array<long>").dropDuplicates(["key"])
    members = saved(sketches.select("key", "size", F.posexplode("bands").alias("band", "bucket")), "bands")
    counts = members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key").alias("order"), "key", "size")).alias("first"))
    counts = saved(counts.where("n > 1").select("band", "bucket", "n", F.col("first.key").alias("key0"), F.col("first.size").alias("size0")), "buckets")
    like = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)

    some = saved(members.join(counts.where(F.col("n") <= pairwise).select("band", "bucket"), ["band", "bucket"], "left_semi"), "light")
    a, b = some.alias("a"), some.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") < F.col("b.key"))
    pairs = a.join(b, same & like(F.col("a.size"), F.col("b.size"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    stars = members.join(counts.where(F.col("n") > pairwise), ["band", "bucket"]).where((F.col("key") != F.col("key0")) & like(F.col("size"), F.col("size0")))
    pairs = saved(pairs.union(stars.select(F.least("key", "key0"), F.greatest("key", "key0"))).distinct(), "candidates")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], ["key", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("x", "y"))):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        used = texts.join(ends, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(hashed, "key long, hashes binary")
        used = saved(used, "candidates")  # a text's set is made once, however many pairs it is in
        left, right = (used.select(F.col("key").alias(k), F.col("hashes").alias(t)) for k, t in (("a", "x"), ("b", "y")))
        return saved(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "similar")

    links = verified(pairs)
    first = counts.where(F.col("n") > pairwise).select("band", "bucket", "key0")
    crowd = saved(members.join(first, ["band", "bucket"]), "crowd")
    if crowd.isEmpty():
        return links
    # gather the groups in crowded buckets: what isn't linked to one text is compared with the next
    rest, n, pivot, found = crowd.select("band", "bucket", "key", "size"), None, first.withColumnRenamed("key0", "pivot"), links
    for _ in range(rounds):
        near = found.select(F.col("a").alias("key"), F.col("b").alias("pivot")).union(found.select("b", "a"))
        left = rest.join(pivot, ["band", "bucket"]).where("key <> pivot").join(near, ["key", "pivot"], "left_anti")
        rest, before = saved(left.select("band", "bucket", "key", "size"), "rest"), n
        n = rest.count()
        if not n or before is not None and n > 0.9 * before:
            break
        pivot = rest.groupBy("band", "bucket").agg(F.min(F.struct(F.xxhash64("key").alias("order"), F.col("key").alias("pivot"), F.col("size").alias("size1"))).alias("p"))
        pivot = saved(pivot.select("band", "bucket", "p.pivot", "p.size1"), "pivots")
        more = rest.join(pivot, ["band", "bucket"]).where((F.col("key") != F.col("pivot")) & like(F.col("size"), F.col("size1")))
        found = verified(saved(more.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "candidates"))
        links = saved(links.union(found).distinct(), "links")
    # texts of crowded buckets by component, and which of them are apart from the first text of a bucket
    label = components(links).select(F.col("node").alias("key"), "root")
    texts_of = crowd.select("key", "size").distinct().join(label, "key", "left").select("key", "size", F.coalesce("root", "key").alias("root"))
    texts_of = saved(texts_of, "crowded")
    root = texts_of.select("key", "root")
    ends = crowd.select("key", "key0").distinct().join(root, "key").join(root.select(F.col("key").alias("key0"), F.col("root").alias("root0")), "key0")
    apart = saved(ends.where("root <> root0").select("key").distinct(), "apart")
    if apart.isEmpty():
        return links
    again = prefix_pairs(texts.join(texts_of, "key").dropDuplicates(["key"]), apart, shingle=shingle, least=least)
    return links.union(verified(saved(again.join(links, ["a", "b"], "left_anti"), "candidates"))).distinct()


_SLOTS = 1 << 20
_BITS = 512


def prefix_pairs(texts: DataFrame, apart: DataFrame, *, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of keys of texts (key, text, root) with different roots, one of the two in `apart`, that can be similar by prefix, size and place.

    The driver gathers, and sends, how often shingles occur, in 2 ** 20 slots by hash, and which of these slots the
    first shingles of texts apart have: 5 MB whatever the tables. Any counts give right pairs; good ones few.
    """
    mask = np.uint64(_SLOTS - 1)
    texts = texts.join(apart.withColumn("apart", F.lit(True)), "key", "left").select("key", "root", "text", F.coalesce("apart", F.lit(False)).alias("apart"))
    texts = saved(texts, "texts")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(_SLOTS, np.int64)
            for t in batch.column("text").to_pylist():
                np.add.at(n, (np.unique(shingle_hashes(t, shingle)) & mask).astype(np.int64), 1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])

    counts = texts.select("text").mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(_SLOTS, np.int64)
    often[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(often)
    prefix = lambda n, share: n - math.ceil(share * n - 1e-9) + 1

    def ordered(text: bytes) -> np.ndarray:
        h = np.unique(shingle_hashes(text, shingle))
        return h[np.lexsort((h, sent.value[(h & mask).astype(np.int64)]))]

    def first_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(_SLOTS, bool)
            for t in batch.column("text").to_pylist():
                h = ordered(t)
                seen[(h[: prefix(len(h), least)] & mask).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["slot"])

    wanted = np.zeros(_SLOTS, bool)
    wanted[texts.where("apart").select("text").mapInArrow(first_slots, "slot long").distinct().toArrow().column("slot").to_numpy()] = True
    asked = texts.sparkSession.sparkContext.broadcast(wanted)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, root, text, own in zip(*(batch.column(c).to_pylist() for c in ("key", "root", "text", "apart"))):
                h = ordered(text)
                n = len(h)
                odd = np.bincount((h >> np.uint64(40) & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) % 2 == 1
                bitmap = np.packbits(odd).view("<i8").tolist()
                h = h[: prefix(n, least)]
                at = np.flatnonzero(asked.value[(h & mask).astype(np.int64)])
                same = lambda v, kind: pa.array(np.full(len(at), v), kind)  # noqa: E731, B023
                cols = [pa.array(h[at].view(np.int64)), same(key, pa.int64()), same(root, pa.int64()), same(own, pa.bool_()), same(n, pa.int64()), pa.array(n - at), pa.array(at < prefix(n, 2 * least / (1 + least))), *(same(x, pa.int64()) for x in bitmap)]
                yield pa.RecordBatch.from_arrays(cols, ["token", "key", "root", "apart", "n", "left", "listed", *words])

    words = [f"b{i}" for i in range(_BITS // 64)]
    kind = "token long, key long, root long, apart boolean, n long, left long, listed boolean" + "".join(f", {w} long" for w in words)
    rows = saved(texts.mapInArrow(prefixes, kind), "prefixes")
    a, b = rows.where("listed").alias("a"), rows.alias("b")
    c = F.col
    shorter = (c("a.n") < c("b.n")) | ((c("a.n") == c("b.n")) & (c("a.key") < c("b.key")))
    room = F.least("a.left", "b.left") * (1 + least) >= least * (c("a.n") + c("b.n")) - 1e-6
    apart_bits = sum((F.bit_count(c(f"a.{w}").bitwiseXOR(c(f"b.{w}"))) for w in words[1:]), F.bit_count(c(f"a.{words[0]}").bitwiseXOR(c(f"b.{words[0]}"))))
    near = apart_bits * (1 + least) <= (1 - least) * (c("a.n") + c("b.n")) + 1e-6
    on = (c("a.token") == c("b.token")) & (c("a.root") != c("b.root")) & (c("a.apart") | c("b.apart")) & shorter & (c("a.n") >= least * c("b.n")) & room & near
    return a.join(b, on).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()
