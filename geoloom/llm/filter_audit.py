"""How five filters on documents act together, in every order, from a sparse document-term matrix.

The matrix is built in shards of about 4 MB of text. A task reads a run of texts, finds the run's distinct words,
and writes the counts as compressed sparse rows (`indptr`, `indices`, `data`) over the run's own word numbers,
with the list of these words, dealt into `buckets` by hash. For the global dictionary the buckets of all shards
meet, so a word is sent once per shard, however often it occurs, and a bucket is a small part of the vocabulary;
each word gets a number of its own there, 0 to V - 1 over all buckets. Each shard is then rewritten to the global
numbers. Its rows' sums are the documents' words, its rows' stored entries their distinct words; these decide A
and B. The other flags come with the shard:

- A: under `min_words` words; B: 100 * distinct words < `distinct_percent` * words;
- C: 100 * characters A-Z > `upper_percent` * code points; D: any of `symbols`;
- E: the text is that of a document of smaller id (by SHA-256, over the whole table).

A document's flags are a set of five. Documents are counted by part and set, partially before the shuffle, so
what comes after has 32 rows a part at most and doesn't grow with the documents. In an order of filters a
document goes at the first that it fails; the sums over all 120 orders follow from the counts of sets.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with their case.

Edge cases: a null text is an empty one, and equal to other empty ones. A null id is smaller than none, and not
larger: E doesn't hold for it, nor through it. Rows that repeat id and text don't make each other fail E. A null part is the empty string.
A null label, or none, is neither good nor toxic; of several labels of one id the largest counts. Empty
tables give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_words, runs, saved, type_of

FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)


def _bytes_in(values: str) -> np.ndarray:
    return np.isin(np.arange(256), list(values.encode()))


def sparse_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """indptr, indices, data and the words that indices are places of."""
    words, index, n_words = distinct_words(b" ".join(texts) + b" ", np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cell, data = np.unique(np.repeat(np.arange(len(texts)), n_words) * max(1, len(words)) + index, return_counts=True)
    row, column = np.divmod(cell, max(1, len(words)))
    return np.searchsorted(row, np.arange(len(texts) + 1)), column, data, words


_BYTES, _PLACES = np.random.default_rng(12).integers(0, 1 << 64, (2, 256), np.uint64)


def bucket_of(words: pa.LargeBinaryArray, buckets: int) -> np.ndarray:
    """For each word, none of them empty, its bucket, by a hash of its bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    read = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(read)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    code = np.add.reduceat(_BYTES[read] * _PLACES[place % 256], offsets[:-1] - offsets[0]) if len(words) else np.empty(0, np.uint64)
    return ((code ^ (code >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def term_shards(docs: DataFrame, *, doc_id: str, text: str, part: str, symbols: str, buckets: int) -> DataFrame:
    """Shards over their own words: shard, docs (id, part, upper, chars, symbol, digest), indptr, indices, data (int32 bytes), words by bucket."""
    kind = type_of(docs, doc_id)
    of_docs = f"array<struct<id:{kind},part:string,upper:long,chars:long,symbol:boolean,digest:binary>>"
    capital, marks = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in(symbols)
    later = np.arange(256) & 0xC0 == 0x80  # bytes within a code point

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for first, run in runs(batch.column("text").to_pylist(), 4 << 20):
                read = np.frombuffer(b" ".join(run) + b" ", np.uint8)
                start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)])[:-1]
                count = lambda table: np.add.reduceat(table[read], start, dtype=np.int64)  # noqa: E731, B023
                chars = np.diff(np.append(start, len(read))) - 1 - count(later)
                indptr, indices, data, words = sparse_rows(run)
                bucket = bucket_of(words, buckets)
                order = np.argsort(bucket, kind="stable")  # the shard's words go by bucket
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                indices = rank[indices]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                by_bucket = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(order)).cast(pa.binary()))
                own = [batch.column(c)[first : first + len(run)] for c in ("id", "part", "digest")]
                rows = pa.StructArray.from_arrays([own[0], own[1], pa.array(count(capital)), pa.array(chars), pa.array(count(marks) > 0), own[2]], ["id", "part", "upper", "chars", "symbol", "digest"])
                whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                blob = lambda x: pa.array([x.astype("<i4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"]), whole(rows), blob(indptr), blob(indices), blob(data), whole(by_bucket)], ["shard", "docs", "indptr", "indices", "data", "words"])
                number += 1

    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    return rows.mapInArrow(of_batches, f"shard string, docs {of_docs}, indptr binary, indices binary, data binary, words array<array<binary>>")


def numbered_words(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each shard and bucket the words' global numbers (shard, bucket, start, terms: int32 bytes, to be added to start); and the dictionary (word, term)."""
    lists = shards.select("shard", F.posexplode("words").alias("bucket", "words"))

    def of_bucket(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        words = pc.list_flatten(lists).dictionary_encode()
        number = words.indices.to_numpy().astype("<i4").tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        terms = [number[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())] + [None]
        shard = pa.concat_arrays([table.column("shard").combine_chunks(), pa.nulls(1, pa.string())])
        listed = pa.array([None] * table.num_rows + [words.dictionary.to_pylist()], pa.list_(pa.binary()))  # the bucket's own row
        bucket = pa.array(np.full(len(terms), table.column("bucket")[0].as_py()), pa.int32())
        return pa.table([shard, bucket, pa.array(terms, pa.binary()), listed], ["shard", "bucket", "terms", "words"])

    found = saved(lists.groupBy("bucket").applyInArrow(of_bucket, "shard string, bucket int, terms binary, words array<binary>"), "terms")
    sizes = found.where("shard IS NULL").select("bucket", F.size("words").alias("n"))  # a row per bucket
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    found = found.join(F.broadcast(saved(start, "starts")), "bucket")
    word = F.substring(F.col("w.col"), F.lit(1), F.octet_length("w.col") - 1)  # without the blank at its end
    words = found.where("shard IS NULL").select("start", F.explode(F.transform("words", lambda x, i: F.struct(i.alias("pos"), x.alias("col")))).alias("w"))
    return found.where("shard IS NOT NULL").select("shard", "bucket", "start", "terms"), words.select(word.alias("word"), (F.col("start") + F.col("w.pos")).alias("term"))


def local_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", symbols: str = "#$%&*|", buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The shards over their own words, each with the global numbers of these (`terms`, last), and the dictionary (word, term)."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = saved(term_shards(docs, doc_id=doc_id, text=text, part=part, symbols=symbols, buckets=buckets), "shards")
    numbers, words = numbered_words(shards)
    own = numbers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "start", "terms"))).alias("terms"))  # an entry per bucket
    kept = shards.drop("words")
    return kept.join(own, "shard").select(*kept.columns, "terms"), words


def renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards over global word numbers, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            terms = [np.frombuffer(x["terms"], "<i4").astype("<i8") + x["start"] for x in row.column("terms")[0].as_py()]
            indices = np.concatenate(terms)[np.frombuffer(row.column("indices")[0].as_buffer(), "<i4")]
            yield row.drop_columns(["terms"]).set_column(3, "indices", pa.array([indices.tobytes()], pa.binary()))


def term_matrix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The shards of the document-term matrix over global word numbers (indices are int64 bytes), and the dictionary (word, term).

    Options: doc_id, text, part, symbols, and buckets, the parts of the dictionary, each of which one task numbers;
    as many as shuffle partitions if not given.
    """
    local, words = local_shards(docs, **options)
    return local.mapInArrow(renumbered, local.drop("terms").schema), words


def document_flags(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, symbols: str = "#$%&*|"
) -> DataFrame:
    """Per document: id, part, n_words, n_distinct, flags (bit 0: fails A, ..., bit 4: fails E)."""
    local, _ = local_shards(docs, doc_id=doc_id, text=text, part=part, symbols=symbols)
    kind = type_of(docs, doc_id)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in renumbered(batches):
            indptr, data = (np.frombuffer(shard.column(c)[0].as_buffer(), "<i4") for c in ("indptr", "data"))
            ends = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
            n_words, n_distinct = np.diff(ends[indptr]), np.diff(indptr).astype(np.int64)
            rows = shard.column("docs")[0].values
            ids, parts, upper, chars, symbol, digest = (rows.field(k) for k in range(6))
            fails = (n_words < min_words) | (100 * n_distinct < distinct_percent * n_words) << 1
            fails = fails | (100 * upper.to_numpy() > upper_percent * chars.to_numpy()) << 2 | symbol.to_numpy(zero_copy_only=False).astype(np.int64) << 3
            yield pa.RecordBatch.from_arrays([ids, parts, pa.array(n_words), pa.array(n_distinct), pa.array(fails, pa.int32()), digest], ["id", "part", "n_words", "n_distinct", "flags", "digest"])

    rows = local.mapInArrow(of_batches, f"id {kind}, part string, n_words long, n_distinct long, flags int, digest binary")
    rows = saved(rows, "flags")
    copies = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = rows.join(saved(copies, "copies"), "digest", "left")
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return found.select("id", "part", "n_words", "n_distinct", F.when(again, F.col("flags").bitwiseOR(F.lit(16))).otherwise(F.col("flags")).alias("flags"))


def interactions(flags: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Per part, order of filters and step: the counts, as the module says. flags: from `document_flags`."""
    known = labels.groupBy(F.col(label_id).alias("__id")).agg((F.max(good) == 1).alias("__good"), (F.max(toxic) == 1).alias("__toxic"))
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    sets = flags.join(known, flags["id"] == known["__id"], "left").groupBy("part", "flags").agg(F.count("*").alias("n"), count("__good").alias("good"), count("__toxic").alias("toxic"))
    by_part = sets.groupBy("part").agg(F.collect_list(F.struct("flags", "n", "good", "toxic")).alias("sets"))  # 32 sets at most
    total = lambda test, of="n": F.aggregate(F.filter("sets", test), F.lit(0).cast("long"), lambda a, s: a + s[of])
    per_filter = lambda value: F.array(*(value(i) for i in range(len(FILTERS))))
    has = lambda s, i: s["flags"].bitwiseAND(F.lit(1 << i)) != 0

    def left(of: str) -> Column:
        """For every set of filters the rows that fail none of them."""
        return F.transform(F.sequence(F.lit(0), F.lit(_SETS - 1)), lambda f: total(lambda s: s["flags"].bitwiseAND(f) == 0, of))

    share = lambda i: F.aggregate(F.filter("sets", lambda s: has(s, i)), F.lit(0).cast("long"), lambda a, s: a + s["n"] * (F.lit(120) / F.bit_count(s["flags"])).cast("long"))
    counted = by_part.select(
        "part", *(left(k).alias(f"left_{k}") for k in ("n", "good", "toxic")),
        per_filter(lambda i: total(lambda s: has(s, i))).alias("fails"), per_filter(lambda i: total(lambda s: s["flags"] == (1 << i))).alias("unique"), per_filter(share).alias("shapley"),
    )
    steps = []
    for order in permutations(range(len(FILTERS))):
        for k, i in enumerate(order):
            before = sum(1 << j for j in order[:k])
            steps.append({"filter_order": "".join(FILTERS[j] for j in order), "step": k + 1, "i": i, "before": before, "after": before | 1 << i})
    kind = "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>"
    rows = counted.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), kind)))
    removed = lambda of: F.get(f"left_{of}", "s.before") - F.get(f"left_{of}", "s.after")
    of_filter = lambda c: F.get(c, "s.i")
    return rows.select(
        "part", "s.filter_order", "s.step", F.get("left_n", "s.after").alias("kept"), removed("n").alias("removed"), (of_filter("fails") - removed("n")).alias("redundant"),
        of_filter("unique").alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), of_filter("shapley").alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(document_flags(docs), labels)


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] f, coalesce(quality = 1, false) good, coalesce(toxic = 1, false) toxic
  FROM d LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, f, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) step FROM o),
r AS (
  SELECT part, array_to_string(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), '') filter_order, step, n, good, toxic, f[o[step]] own, list_bool_or(list_transform(o[1:step - 1], lambda x: f[x])) gone,
    list_sum(list_transform(f, lambda x: CAST(x AS INTEGER))) fails, o[step] x
  FROM c, s),
p AS (
  SELECT part, filter_order, step, x, sum(n) FILTER (NOT coalesce(gone, false) AND NOT own) kept, sum(n) FILTER (NOT coalesce(gone, false) AND own) removed, sum(n) FILTER (gone AND own) redundant,
    sum(n) FILTER (own AND fails = 1) unique_fails, sum(good) FILTER (NOT coalesce(gone, false) AND own) good_lost, sum(toxic) FILTER (NOT coalesce(gone, false) AND own) toxic_lost
  FROM r GROUP BY ALL),
y AS (SELECT *, sum(removed) OVER (PARTITION BY part, x) shapley FROM p)
SELECT part, filter_order, CAST(step AS INTEGER) step, CAST(coalesce(kept, 0) AS BIGINT) kept, CAST(coalesce(removed, 0) AS BIGINT) removed, CAST(coalesce(redundant, 0) AS BIGINT) redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) shapley
FROM y
"""
