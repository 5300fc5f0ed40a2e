import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import simhash as op
from geoloom.llm.components import components


def fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def closed(nodes, linked):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("options", [{}, {"pairwise": 1}, {"pairwise": 0, "segments": 16}])
def test_links_against_all_pairs(spark, options):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    edges = op.links(df, **options).collect()
    un = lambda x: x % (1 << 64)
    assert all((un(a) ^ un(b)).bit_count() <= 2 for a, b in edges)
    every = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    want, got = closed(prints, every), closed(prints, [(un(a), un(b)) for a, b in edges])
    assert want == got


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    good = [(a, b) for a, b in edges if b is not None and a != b]
    want = closed({x for e in good for x in e}, good)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_edges(spark):
    texts = ["a b c d e f g", "A  b\tc d e f g", "a b c d e f g", None, "", "  ", "x", "x y", "the quick brown fox", "ünï cödé " * 20, "w " * 3000]
    docs = list(enumerate(texts)) + [(0, texts[0]), (None, "x y"), (None, "lonely null")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fingerprint int")
    rows = op.near_duplicates(df.drop("fingerprint")).collect()
    un = lambda x: x % (1 << 64)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in docs:
        assert un(fingerprint(t)) in {un(r.fingerprint) for r in by[i]}
    comp = {i: {r.component_id for r in by[i]} for i in by}
    assert comp[0] == comp[1] == comp[2] == {0} and comp[3] == comp[4] == comp[5] == {3} and comp[7] == {7} and comp[None] == {7, None}
    kept = op.one_of_each(df).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(0) == 1 and not {1, 2, 4, 5} & set(ids) and 3 in ids and 7 in ids and sum(r.text == "lonely null" for r in kept) == 1
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_large_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text that many have in common").otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    rows = op.near_duplicates(df)
    assert rows.where("component_id = 0").count() == 1000 and rows.count() == 3000


def test_registered_query_against_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = closed(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = op.op6_simhash(spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
