"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of `window` consecutive words (an item with fewer words is one
window), and a window into shingles of `shingle` words. A document holds a window only if it holds every
shingle of it, so for exact containment the necessary prefix of a window is one shingle: its rarest.

1. Count, over all documents, the shingles that occur in the benchmark.
2. Order each window's shingles by that count and keep the rarest, with its position. A window that has a
   shingle of count 0 occurs nowhere and goes.
3. Join document shingles with the prefixes. What is sent to the executors to skip other shingles early is
   a bitmap of bounded size; the join on the shingle's text is exact.
4. From the two positions follows where the window would start. Bounds: the start isn't negative, the end
   isn't beyond the document's length.
5. Compare the words there with the window's words.

Edge cases: a null text has no words. Repeated rows are judged one by one and alike. An item without words
has no windows; one with a null id marks words as hit but isn't among the items listed. Items with equal
windows are all listed. An empty benchmark hits nothing. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, ascii_lower, saved, type_of

#: The bitmap has about a thousand slots per shingle, so few others pass, as a power of two between these: 8 KB to 16 MB.
LEAST_BITS, MOST_BITS = 16, 27
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slots(words: list[bytes], k: int, power: int) -> np.ndarray:
    """The bitmap slot of each k-word shingle, of 2**power."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    code = np.fromiter(map(crc32, words), np.uint64, len(words))
    total = code[:n] + np.uint64(k)
    for i in range(1, k):
        total = total * _STEP + code[i : i + n]
    return (total * _STEP) >> np.uint64(64 - power)


def _places(words: list[bytes], bits: np.ndarray, sizes: list[int]) -> list[tuple[int, bytes]]:
    """Where shingles begin that may be in the bitmap, and their text."""
    found = []
    power = len(bits).bit_length() + 2
    for k in sizes:
        at = _slots(words, k, power)
        for i in np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).tolist():
            found.append((i, b" ".join(words[i : i + k])))
    return found


def benchmark_windows(benchmark: DataFrame, *, item_id: str, item_text: str, window: int) -> DataFrame:
    """One row per distinct window: its words, and the items that have it."""
    words = F.filter(F.split(ascii_lower(F.col(item_text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    return (
        items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """The shingles of each window with their places; a window of fewer words is one shingle."""
    k = F.least(F.lit(shingle), F.size("window"))
    places = F.sequence(F.lit(0), F.size("window") - k)
    cut = F.transform(places, lambda p: F.struct(p.alias("place"), F.array_join(F.slice("window", p + 1, k), " ").alias("shingle")))
    return windows.select("window", "items", k.alias("k"), F.inline(cut))


def _bitmap(shingles: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bitmap, as bytes, and the shingle sizes. Slots are joined to words of 64 in partial aggregates; the driver gets the words that aren't zero, at most 16 MB of them."""
    rows = shingles.select("shingle", "k").distinct()
    sizes = rows.groupBy("k").count().collect()  # at most as many rows as words in a shingle
    power = min(MOST_BITS, max(LEAST_BITS, (1024 * sum(r["count"] for r in sizes)).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(_slots(w.encode().split(b" "), k, power)[0]) for w, k in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["slot"])

    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = rows.mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 6), "<i8")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8), sorted(r.k for r in sizes)


def shingle_counts(docs: DataFrame, text: str, bits, sizes: list[int]) -> DataFrame:
    """How often the shingles of the bitmap occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for value in batch.column(0).to_pylist():
                if value:
                    seen.update(s for _, s in _places(value.translate(WORD_BYTES).split(), bits.value, sizes))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shingle", "n"])

    found = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "shingle binary, n long")
    return found.groupBy(F.col("shingle").cast("string").alias("shingle")).agg(F.sum("n").alias("n"))


def prefix_of(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window's rarest shingle and its place; windows with a shingle that no document has are left out."""
    known = shingles.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = known.groupBy("window", "items", "k").agg(F.min(F.struct("n", "shingle", "place")).alias("best"))
    return best.where("best.n > 0").select("window", "items", "k", "best.shingle", "best.place")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shingle: int = 5,
    share: tuple[int, int] = (1, 20),
) -> DataFrame:
    """One row per document: id, text_key (xxhash64 of the text), n_words, n_hit, items (sorted ids), contaminated.

    A word is hit if it lies in an occurrence of a window. A document is contaminated if at least
    share[0]/share[1] of its words, and one word, are hit.
    """
    spark = docs.sparkSession
    shingles = saved(window_shingles(benchmark_windows(benchmark, item_id=item_id, item_text=item_text, window=window), shingle), "windows")
    all_bits, sizes = _bitmap(shingles)
    prefixes = saved(prefix_of(shingles, shingle_counts(docs, text, spark.sparkContext.broadcast(all_bits), sizes)), "prefixes")
    few_bits, sizes = _bitmap(prefixes)
    bits = spark.sparkContext.broadcast(few_bits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, value in enumerate(batch.column("text").to_pylist()):
                words = (value or b"").translate(WORD_BYTES).split()
                found = _places(words, bits.value, sizes)
                for at, key in found:
                    first = max(0, at - window + 1)
                    rows.append((n, len(words), at, key, first, words[first : at + window]))
                if not found:
                    rows.append((n, len(words), None, b" %d" % n, None, None))  # no shingle begins with a blank
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            kept = [batch.column(c).take(cols[0]) for c in ("row", "id", "text_key")]
            yield pa.RecordBatch.from_arrays([*kept, *cols[1:]], ["row", "id", "text_key", "n_words", "at", "shingle", "first", "around"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text")
    ).mapInArrow(
        search,
        f"row long, id {type_of(docs, doc_id)}, text_key long, n_words long, at long, shingle binary, first long, around array<binary>",
    )
    start = F.col("at") - F.col("place")
    bounded = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = F.slice(F.transform("around", lambda w: w.cast("string")), (start - F.col("first") + 1).cast("int"), F.size("window")) == F.col("window")
    place = F.when(F.when(bounded, same), F.struct(start.alias("s"), (start + F.size("window")).alias("e")))
    pairs = rows.withColumn("shingle", F.col("shingle").cast("string")).join(prefixes.drop("k"), "shingle", "left").withColumn("place_hit", place)
    judged = pairs.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("text_key").alias("text_key"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("place_hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("place_hit").isNotNull(), F.col("items")))))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    n_hit = F.aggregate(
        "hits",
        zero,
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0).cast("long"), x.e - F.greatest(a.e, x.s))).alias("n"), F.greatest(a.e, x.e).alias("e")),
        lambda a: a.n,
    )
    out = judged.select(F.col("id").alias(doc_id), "text_key", "n_words", n_hit.alias("n_hit"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0]))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that `contamination` doesn't call contaminated."""
    bad = contamination(docs, benchmark, doc_id=doc_id, text=text, **options).where("contaminated")
    bad = bad.select(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key")), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 13) size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) s FROM i WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
dw AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT doc_id, s, iw.size, item FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
