import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import language_id as op

LENGTHS = (2, 3, 4)


def brute_grams(text):
    words, now = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c
        elif now:
            words.append(now)
            now = ""
    line = " " + " ".join(words) + " " if words else ""
    return [line[i : i + n] for n in LENGTHS for i in range(len(line) - n + 1)]


def brute_filters(rows, least):
    """The n-grams of each language, and its number of documents."""
    size, count = Counter(), defaultdict(Counter)
    for text, lang in rows:
        size[lang] += 1
        for g in set(brute_grams(text)):
            count[g][lang] += 1
    has = defaultdict(set)
    for g, n in count.items():
        share = {lang: n[lang] / size[lang] for lang in n}
        for lang, s in share.items():
            if s >= least * max(share.values()):
                has[lang].add(g)
    return has, size


def brute_best(text, has, size):
    grams = brute_grams(text)
    hits = {lang: sum(g in has[lang] for g in grams) for lang in size}
    return min(size, key=lambda x: (-hits[x], -size[x], x)), {k: v / max(1, len(grams)) for k, v in hits.items()}


TEXTS = [
    ("the house and the garden, they say", "en"), ("over there the other thing", "en"), ("that is what the weather does", "en"), ("der Garten und das Haus sind schön", "de"), ("über die Straße geht der große Hund", "de"),
    ("la casa y el jardín de la niña", "es"), ("el año que viene será mejor", "es"), ("ภาษาไทย เป็นภาษา", "th"), ("the and the", "de"), ("", "en"), (None, "en"), ("no label", None), ("x1y2 ÄÖ", ""),
]


def test_ngrams_against_brute_force():
    texts = ["", "a", " a-b ", "Über  die\nStraße", "123 !!", "ÄÖ", "áb c", "İstanbul", "𝒳 x", "ab" * 50]
    grams = op.ngrams([t.encode() for t in texts], LENGTHS)
    code = {}
    for i, t in enumerate(texts):
        mine, want = grams.code[grams.text == i].tolist(), brute_grams(t)
        assert len(mine) == len(want)
        for c, g in zip(mine, want):
            assert code.setdefault(g, c) == c
    assert len(set(code.values())) == len(code)
    assert grams.letters.tolist() == [sum(unicodedata.category(c)[0] == "L" for c in t.lower()) for t in texts]


def test_filters_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, lang, 0) for i, (t, lang) in enumerate(TEXTS)], "doc_id long, text string, lang string, score int").repartition(3)
    filters = op.learned(docs)
    rows = [(t, lang) for t, lang in TEXTS if t is not None and lang is not None]
    has, size = brute_filters(rows, 0.2)
    assert filters.names == sorted(size, key=lambda x: (-size[x], x))
    # every language that has an n-gram is found; others only by chance
    known = sorted(set().union(*has.values()))
    code = np.concatenate([_code(g) for g in known])
    bits = filters.languages(code)
    wrong = 0
    for g, b in zip(known, bits):
        found = {name for i, name in enumerate(filters.names) if b[i // 8] >> i % 8 & 1}
        must = {name for name in has if g in has[name]}
        assert must <= found
        wrong += len(found - must)
    assert wrong <= 0.02 * len(known) * len(size)
    assert (filters.chance < 0.01).all()
    out = {r.doc_id: r for r in op.predicted(docs, filters).collect()}
    for i, (t, _) in enumerate(TEXTS):
        if not t:
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
        else:
            best, share = brute_best(t, has, size)
            assert out[i].lang_pred == best and out[i].score == pytest.approx(share[best], abs=0.06)


def _code(gram):
    """The hash of an n-gram by the module's own rule, on an array of its characters."""
    code = op._ODD[1:2].copy()
    for c in gram:
        code = (code ^ np.uint64(ord(c))) * op._ODD[0]
        code ^= code >> np.uint64(32)
    return code & op._HIGH


def test_a_full_filter_is_corrected(spark):
    # a filter far too small for its n-grams still decides, as chance is taken off
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = op.held_out("doc_id", 4, 2)
    filters = op.learned(docs.where(~held), max_bytes=1 << 14)
    assert filters.table.nbytes == 1 << 14 and filters.chance.max() > 0.5
    right = op.predicted(docs.where(held), filters).join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op.op13_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    rows = found.groupBy("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score"), F.max("score")).collect()
    assert len(rows) == 2 and sum(r.n for r in rows) == docs.count()
    for r in rows:
        assert r.right >= 0.98 and 0 <= r["min(score)"] <= r["max(score)"] <= 1


def test_many_languages_and_edges(spark):
    rows = [(f"{chr(0x4E00 + 50 * k)}{chr(0x4E01 + 50 * k)} common words", f"l{k:02d}") for k in range(70)]
    docs = spark.createDataFrame(rows * 2, "text string, lang string")
    filters = op.learned(docs)
    assert filters.table.shape[1] == 9
    texts = spark.createDataFrame([(k, t, 1) for k, (t, _) in enumerate(rows)] + [(None, "12 -- !", 1), (100, "q", 1)], "doc_id long, text string, lang_pred int")
    got = {r.doc_id: r for r in op.predicted(texts, filters).collect()}
    assert [got[k].lang_pred for k in range(70)] == [lang for _, lang in rows]
    assert got[None].lang_pred == "und" and (got[100].lang_pred, got[100].score) == ("l00", 0.0)
    none = docs.limit(0)
    assert op.learned(none) is None and op.predicted(texts.limit(0), filters).count() == 0
    assert {r.lang_pred for r in op.predicted(texts, None).collect()} == {"und"}
