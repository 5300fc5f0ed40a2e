"""URL filters: rules by host and path, and for all other URLs a classifier of segmented host and path tokens.

Rules: a rule fits its host and all subdomains if the URL's path starts with the rule's; the longest wins.
Fitting rules are found by an equi-join on the host's suffixes.

Classifier: the host's labels and the path's parts are split into words by unigram Viterbi. Word counts come
from the pages' own texts, all of them, words of any length. Every substring of up to SHORT characters of a
distinct label or part is joined with the counts of words as short, and every one of just SHORT characters
with longer words that begin so; a pass over the matches, by where they end, finds the best split: the counts
are nowhere sent whole, and the work grows with a name's length and its matches. A character outside of any
counted word costs more than a rare word. A multinomial naive Bayes model, learned from the URLs that the
rules decide, then scores the words: one sum of word counts by verdict; words that no decided URL has say
nothing.

Labels, parts and words occur many times, so each is treated once, and URLs get their scores by joins on
them, for which the URLs' side is dealt by word and page; Spark splits partitions of very frequent words.

Edge cases: a null URL or one without :// has an empty host and path and no words; its verdict is the more
frequent one among the decided, as is that of words never seen; of equal scores the verdict is allow, also
when no URL is decided. Repeated rows are judged each, and so are pages with a null id. Null texts have no
words. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

#: Words of up to so many characters are found by whole substrings, longer ones by what they begin with.
SHORT = 20
_TAG, _WORD = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z\x80-\xff]+")


def without_tags(text: bytes) -> bytes:
    """A blank for each <...>. Only as far as a > follows: there, every < finds one at the first try."""
    closed = text.rfind(b">") + 1
    return _TAG.sub(b" ", text[:closed]) + b" " + text[closed:]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty if it is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (with key, host, path) with rule and rule_verdict, null where none fits. rules: (verdict, host, path)."""
    table = urls.sparkSession.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    by_host = hosts.join(F.broadcast(table), "rule_host").groupBy("host").agg(F.collect_list(F.struct("rule_verdict", "rule_host", "rule_path")).alias("rules"))
    fits = F.filter(F.coalesce("rules", F.array().cast("array<struct<rule_verdict:string,rule_host:string,rule_path:string>>")), lambda r: F.startswith("path", r.rule_path))
    sized = F.transform(fits, lambda r: F.struct(F.length(F.concat(r.rule_host, r.rule_path)).alias("n"), F.concat(r.rule_host, r.rule_path).alias("rule"), r.rule_verdict.alias("verdict")))
    # a table: then Spark can split what one host with very many URLs is joined with
    out = urls.join(saved(by_host, "rules"), "host", "left").withColumn("best", F.array_max(sized))
    return out.select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """word, n: the words of all texts, without tags."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(_WORD.findall(without_tags(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = pages.select(F.col(html).cast("binary").alias("html")).mapInArrow(count, "word binary, n long")
    return found.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name and words: the most likely split of each distinct name, from the counts of words.

    A character that no counted word covers is a word of probability 1 / (10 * all counts) by itself. Of
    equally likely splits the one whose last word is longest counts, then the same of what is before it.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    names = names.where("length(name) > 0").distinct()
    starts = F.sequence(F.lit(1), F.length("name"))
    pieces = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(SHORT), F.length("name") - s + 1)), lambda n: F.struct(s.alias("s"), n.alias("n")))))
    spread = names.select("name", F.inline(pieces)).withColumn("part", F.substring("name", F.col("s"), F.col("n")))
    words = counts.select("word", F.length("word").alias("n"), F.col("n").alias("times"))
    short = spread.join(words.where(F.col("n") <= SHORT).select(F.col("word").alias("part"), "times"), "part").select("name", "s", "n", "times")
    long = words.where(F.col("n") > SHORT).select(F.substring("word", 1, SHORT).alias("part"), "word", F.col("n").alias("size"), "times")
    long = spread.where(F.col("n") == SHORT).join(long, "part").where(F.substring("name", F.col("s"), F.col("size")) == F.col("word"))
    found = short.union(long.select("name", "s", F.col("size").alias("n"), "times"))
    found = found.groupBy("name").agg(F.collect_list(F.struct("s", "n", "times")).alias("found"))
    every = float(max(total, 1))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([best_split(n, f or (), every) for n, f in zip(names, batch.column("found").to_pylist())], pa.list_(pa.string()))], ["name", "words"])

    return names.join(found, "name", "left").mapInArrow(split, "name string, words array<string>")


def best_split(name: str, found: list[dict], total: float) -> list[str]:
    """The words of a name, given those at each start (from 1): by the cost of the best split of the first e characters and its last word's length."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for f in found:
        ending.setdefault(f["s"] + f["n"] - 1, []).append((f["n"], -math.log(f["times"] / total)))
    alone = math.log(10 * total)
    best = [(0.0, 0)]
    for e in range(1, len(name) + 1):
        cost, n = min([(best[e - 1][0] + alone, -1), *((best[e - n][0] + cost, -n) for n, cost in ending.get(e, ()))])
        best.append((cost, -n))
    words, e = [], len(name)
    while e:
        words.append(name[e - best[e][1] : e])
        e -= best[e][1]
    return words[::-1]


def name_tokens(host: Column, path: Column) -> Column:
    """The names of a URL that are segmented, marked by where they stand, and its numbers by their length."""
    labels = F.transform(F.filter(F.split(host, r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.struct(F.lit("h:").alias("at"), x.alias("name")))
    parts = F.transform(F.filter(F.split(ascii_lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.struct(F.lit("p:").alias("at"), x.alias("name")))
    number = lambda t: F.struct(t.at.alias("at"), F.when(t["name"].rlike(r"^\p{N}+$"), F.concat(F.lit("#"), F.length(t["name"]))).otherwise(t["name"]).alias("name"))
    return F.transform(F.concat(labels, parts), number)


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    smoothing: float = 1.0,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page; score: log odds of block, null where a rule decides."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
    # URLs of one host and path are judged once
    ruled = saved(rule_of(rows.groupBy("host", "path").count(), rules), "ruled")
    tokens = ruled.select("host", "path", "count", "rule_verdict", F.explode(name_tokens(F.col("host"), F.col("path"))).alias("t"))
    tokens = tokens.select("host", "path", "count", "rule_verdict", "t.at", "t.name")
    names = tokens.select("name").distinct()
    is_number = F.col("name").startswith("#")
    split = segmented(names.where(~is_number), saved(word_counts(pages, html), "words"))
    split = saved(split.union(names.where(is_number).select("name", F.array("name"))), "names")
    # a name's words by where it stands, and how often the decided URLs have them
    decided = tokens.where("rule_verdict IS NOT NULL").groupBy("at", "name").agg(
        F.sum(F.when(F.col("rule_verdict") == "block", F.col("count")).otherwise(0)).alias("block"),
        F.sum(F.when(F.col("rule_verdict") == "allow", F.col("count")).otherwise(0)).alias("allow"),
    )
    word = F.concat("at", "w").alias("word")
    counts = decided.join(split, "name").select("at", "block", "allow", F.explode("words").alias("w")).groupBy(word).agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counts = saved(counts, "counts")
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("block", "allow")), F.count("*").alias("words")).first()
    prior = ruled.groupBy("rule_verdict").agg(F.sum("count").alias("n")).where("rule_verdict IS NOT NULL").collect()
    n = {r.rule_verdict: r.n for r in prior}
    odds = lambda c, a: F.log((F.col(c) + smoothing) / F.lit(float(a + smoothing * max(sums["words"], 1))))
    by_word = counts.select("word", (odds("block", sums["block"]) - odds("allow", sums["allow"])).alias("odds"))
    # the score of a name where it stands is the sum over its words; words that no decided URL has say nothing
    placed = tokens.where("rule_verdict IS NULL").select("at", "name").distinct().join(split, "name").select("at", "name", F.explode("words").alias("w"))
    by_name = saved(placed.withColumn("word", word).join(by_word, "word").groupBy("at", "name").agg(F.sum("odds").alias("odds")), "scores")
    open_ = tokens.where("rule_verdict IS NULL").join(by_name, ["at", "name"]).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    start = math.log((n.get("block", 0) + smoothing) / (n.get("allow", 0) + smoothing))
    judged = ruled.join(open_, ["host", "path"], "left").withColumn("score", F.when(F.col("rule").isNull(), F.coalesce("odds", F.lit(0.0)) + F.lit(start)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    judged = judged.select("host", "path", "rule", verdict.alias("verdict"), "score")
    return rows.join(judged, ["host", "path"]).select(F.col("id").alias(page_id), "host", "path", "rule", "verdict", "score")


RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
