import random

import pytest

import corpus_pipeline as cp
from geoloom.llm import jaccard as op

from .test_simhash import closed, fingerprint


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def made(seed):
    rng = random.Random(seed)
    texts = ["", "one two", "One two", "one two three four five six"]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 3000]))]
        for share in (0, 0.005, 0.015, 0.02, 0.03, 0.06):
            texts.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < share else w for w in words))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(dict.fromkeys(texts))]


@pytest.mark.parametrize("pairwise", [128, 1])
def test_stage_links_what_is_similar(spark, pairwise):
    rows = made(4)
    df = spark.createDataFrame([*rows, (None, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    keys = {r.key: r.doc_id for r in df.where("doc_id is not null").selectExpr("doc_id", "xxhash64(text) key").orderBy("doc_id", ascending=False).collect()}
    sets = {i: shingles(t) for i, t, *_ in rows}
    want = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    got = [(keys[e.a], keys[e.b]) for e in op.similar_texts(df, pairwise=pairwise).collect()]
    assert all(similarity(sets[a], sets[b]) >= 0.8 for a, b in got)
    assert closed(sets, got) == closed(sets, want)
    if pairwise == 128:
        assert {tuple(sorted(e)) for e in got} == set(want)
        prints = {i: fingerprint(t) for i, t, *_ in rows}
        bits = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
        root, before = closed(prints, want + bits), closed(prints, bits)
        assert root != before
        kept = {r.doc_id for r in cp.simhash_near_dedup(spark, df, "").collect()}
        assert kept - {None} == {i for i in root if root[i] == i}
    assert op.similar_texts(df.limit(0)).count() == 0


def boilerplate(n, words, own, pairs):
    """n texts with the same boilerplate and own words; of `pairs` pairs both have more in common."""
    rng = random.Random(1)
    common = [f"b{i}" for i in range(words)]
    texts = []
    for k in range(n):
        mine = [f"t{k if k >= 2 * pairs else k // 2}_{i}" for i in range(own)]
        if k < 2 * pairs and k % 2:
            mine[-1] = f"other{k}"
        texts.append(" ".join(common + mine))
    rng.shuffle(texts)
    return texts


def test_crowded_buckets_lose_no_link(spark):
    # 5-word shingles: 400 of boilerplate, 52 of their own; 400 / 504 = 0.794, of a pair more than 0.99 or, cut, 0.80
    texts = boilerplate(200, 404, 52, 100)
    sets = [shingles(t) for t in texts]
    links = {(i, j) for i in range(200) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8}
    assert len(links) == 100
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.key: r.doc_id for r in df.selectExpr("doc_id", "xxhash64(text) key").collect()}
    got = {tuple(sorted((keys[e.a], keys[e.b]), reverse=True)) for e in op.similar_texts(df).collect()}
    assert got == links


def test_pairs_just_over_the_border_in_boilerplate(spark):
    rng = random.Random(7)
    common, texts = [f"b{i}" for i in range(404)], []
    for k in range(100):  # pairs with 3 own shingles in common: 403 / 501 = 0.804; else 400 / 504 = 0.794
        shared = [f"s{k}_{i}" for i in range(3)]
        for side in "xy":
            texts.append(" ".join(common + shared + [f"{side}{k}_{i}" for i in range(49)]))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    links = {(i, j) for i in range(200) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8}
    assert len(links) == 100 and max(similarity(sets[i], sets[j]) for i, j in links) < 0.81
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.key: r.doc_id for r in df.selectExpr("doc_id", "xxhash64(text) key").collect()}
    got = {tuple(sorted((keys[e.a], keys[e.b]), reverse=True)) for e in op.similar_texts(df).collect()}
    assert got == links


def test_prefixes_meet_few(spark):
    # texts that share boilerplate just under the border don't meet; those over it do
    texts = boilerplate(300, 404, 52, 20)
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) key", "xxhash64(text) root", "cast(text as binary) text")
    pairs = op.prefix_pairs(df, df.select("key"), shingle=5, least=0.8)
    assert 20 <= pairs.count() <= 40


def test_two_groups_in_one_bucket(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for group in range(3):
        head = [f"g{group}_{i}" for i in range(60)]
        for k in range(40):
            words = head + base
            for _ in range(2):
                words[rng.randrange(360)] = f"e{group}_{k}_{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    want = closed(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.key: r.doc_id for r in df.selectExpr("doc_id", "xxhash64(text) key").collect()}
    got = closed(range(len(texts)), [(keys[e.a], keys[e.b]) for e in op.similar_texts(df).collect()])
    same = lambda roots: {tuple(sorted(i for i in roots if roots[i] == r)) for r in set(roots.values())}
    assert same(got) == same(want) and len(same(want)) == 3
