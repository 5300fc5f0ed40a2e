"""Removal of multi-line passages that repeat across documents, by content-defined chunks of lines.

A text is cut at newlines. Where chunks end depends on the lines alone, wherever they stand, so lines inserted
before a passage move no boundary in it. A chunk ends

- before and after each line that occurs only once in all documents, so that a passage that repeats is cut off
  from what is around it;
- among lines that repeat, after a line whose rolling hash, over its own hash and those of the `memory` - 1
  lines before it, is less than both its neighbours', if none of the lines that this depends on occurs only
  once or lies before the text.

A chunk with at least two lines that aren't blank, or with more than `words` words, whose bytes occur in more
than one place of all documents stays where it occurs first (by document id, null last, then text hash, then
place in the text) and goes everywhere else. A passage next to lines that repeat without it can share a chunk
with them, and then stays.

First lines are counted by hash, then chunks, both without their text. Only of chunk hashes that occur more
than once are the bytes grouped, so that unlike chunks with equal hashes remove nothing; partial grouping
collapses copies before the shuffle. What goes is then listed per document and joined to the texts.

Everything is DataFrame functions.

Edge cases: null texts stay null, empty ones empty; lines that repeat one by one, but not next to each other,
never go. Rows that repeat id and text are one document: each keeps what the first keeps. A text all of whose
chunks go becomes empty and stays as a row. An empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def part(values: Column, start: Column, end: Column) -> Column:
    """Elements start to end of an array; unlike slice, in proportion to their number."""
    return F.transform(F.sequence(start, end), lambda i: F.get(values, i))


def described(lines: Column, memory: int) -> Column:
    """For each line: place, hash, rolling hash, whether it is full (not blank), number of words."""
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)

    def rolling(h: Column, i: Column) -> Column:
        joined = F.concat(*(F.coalesce(F.get(h, i - back), F.lit("")) for back in reversed(range(memory))))
        return F.unhex(F.substring(F.md5(joined), 1, 16))

    def line(h: Column):
        def one(i: Column) -> Column:
            x = F.get(lines, i)
            return F.struct(
                i.alias("place"), F.xxhash64(x).alias("hash"), rolling(h, i).alias("rolling"), (F.trim(x) != "").alias("full"), F.regexp_count(x, F.lit("[^ ]+")).alias("words")
            )

        return F.transform(numbers, one)

    return once(F.transform(lines, lambda x: F.md5(x)), line)


def chunks_of(lines: Column, memory: int, words: int) -> Column:
    """Chunks of described lines, each also with `often`: start, n, hash, and whether it counts."""
    last = F.size(lines) - 1
    alone = lambda i: ~F.get(lines, i)["often"]  # noqa: E731  null beyond the ends

    def ends(i: Column) -> Column:
        r = lambda j: F.get(lines, j)["rolling"]
        near = reduce(or_, (alone(i + j) for j in range(-memory, 3)))  # on these the rolling hashes depend
        least = (i >= memory) & (i < last - 1) & (r(i) < r(i - 1)) & (r(i) < r(i + 1)) & ~near
        return (i == last) | alone(i) | F.coalesce(alone(i + 1), F.lit(False)) | F.coalesce(least, F.lit(False))

    def cut(e: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1)

            def chunk(own: Column) -> Column:
                full = F.size(F.filter(own, lambda x: x["full"]))
                n_words = F.aggregate(own, F.lit(0), lambda n, x: n + x["words"])
                return F.struct(start.alias("start"), (end - start + 1).alias("n"), F.xxhash64(F.transform(own, lambda x: x["hash"])).alias("hash"), ((full > 1) | (n_words > words)).alias("counts"))

            return once(part(lines, start, end), chunk)

        return F.transform(e, one)

    return once(F.filter(F.sequence(F.lit(0), last), ends), cut)


def without_repeated_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", memory: int = 2, words: int = 50) -> DataFrame:
    """docs, all columns and rows, without repeated chunks in `text`; n_chunks and n_removed are added."""
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    lines = saved(base.select("id", "key", F.inline(once(lines_of(F.col("text")), lambda w: described(w, memory)))), "lines")
    often = saved(lines.groupBy("hash").count().where("count > 1").select("hash", F.lit(True).alias("often")), "often")
    marked = lines.join(often, "hash", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    by_doc = marked.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("place", "hash", "rolling", "full", "words", "often"))).alias("lines"))
    cut = saved(by_doc.select("id", "key", chunks_of(F.col("lines"), memory, words).alias("chunks")), "chunks")
    rows = cut.select("id", "key", F.inline(F.filter("chunks", lambda c: c["counts"]))).drop("counts")
    repeated = saved(rows.groupBy("hash").count().where("count > 1").select("hash"), "repeated")
    # the places of chunks whose hash repeats, by document, and from them the bytes
    suspects = rows.join(repeated, "hash", "left_semi").groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    same = base.id.eqNullSafe(suspects.id) & (base.key == suspects.key)
    own = lambda w: F.transform("places", lambda c: F.struct("id", "key", c["start"].alias("start"), c["n"].alias("n"), F.array_join(part(w, c["start"], c["start"] + c["n"] - 1), "\n").alias("bytes")))
    seen = base.join(suspects, same).select(base.id, base.key, "text", "places").select(F.inline(once(lines_of(F.col("text")), own)))
    seen = seen.select(F.struct(F.col("id").isNull().alias("none"), "id", "key", "start", "n").alias("at"), "bytes")
    seen = saved(seen.withColumn("hash", F.xxhash64("bytes")), "repeats")
    first = seen.groupBy("hash", "bytes").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last").drop("last")
    gone = seen.join(saved(first, "first"), ["hash", "bytes"]).where("at != first").groupBy("at.id", "at.key").agg(F.collect_set(F.struct("at.start", "at.n")).alias("gone"))
    found = cut.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.size("chunks").cast("long").alias("n_chunks"))
    found = found.join(gone, found["__id"].eqNullSafe(gone["id"]) & (found["__key"] == gone["key"]), "left").select(*found.columns, F.col("gone").alias("__gone"))
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key")), "left")
    places = F.flatten(F.transform("__gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))
    # places as a set against a set: in proportion to the lines
    left = lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), places), lambda i: F.get(w, i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(once(lines_of(F.col(text)), left))
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    kept = [c for c in docs.columns if c not in ("n_chunks", "n_removed")]
    return joined.select(*(new.alias(text) if c == text else docs[c] for c in kept), F.coalesce(found["n_chunks"], F.lit(0)).alias("n_chunks"), n_removed.alias("n_removed"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chunks", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents),
m AS (SELECT *, md5(x) h, count(*) OVER (PARTITION BY x) > 1 often FROM l),
r AS (
  SELECT doc_id, list(x ORDER BY i) w, list(NOT often ORDER BY i) u, list(h ORDER BY i) h FROM m GROUP BY doc_id),
q AS (SELECT doc_id, w, u, list_transform(range(1, len(w) + 1), lambda i: md5(coalesce(h[i - 1], '') || h[i])[1:16]) r FROM r),
e AS (
  SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR u[i] OR u[i + 1]
    OR (i > 2 AND i < len(w) - 1 AND r[i] < r[i - 1] AND r[i] < r[i + 1] AND NOT (u[i - 2] OR u[i - 1] OR u[i] OR u[i + 1] OR u[i + 2]))) e
  FROM q),
c AS (
  SELECT doc_id, k, w[coalesce(e[k - 1], 0) + 1:e[k]] lines
  FROM (SELECT *, unnest(range(1, len(e) + 1)) k FROM e)),
b AS (
  SELECT doc_id, k, array_to_string(lines, chr(10)) bytes,
    len(list_filter(lines, lambda x: trim(x) <> '')) > 1 OR list_sum(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^ ]+')))) > 50 many
  FROM c),
f AS (SELECT *, many AND row_number() OVER (PARTITION BY many, bytes ORDER BY doc_id NULLS LAST, k) > 1 gone FROM b),
t AS (
  SELECT doc_id, count(*) n_chunks, count(*) FILTER (gone) n_removed, coalesce(string_agg(bytes, chr(10) ORDER BY k) FILTER (NOT gone), '') t
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_chunks, 0) n_chunks, coalesce(n_removed, 0) n_removed, CAST(strlen(t) AS BIGINT) kept_bytes, sha256(t) text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
