import hashlib
import re

import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(x) for x in ids if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_sql(spark, data, same):
    same(op.op1_decontamination(spark, data), op.OP1_SQL)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Two Words"), (2, "two words"), (None, "alone here"), (4, ""), (5, None), (6, "ünï Cödé é"), (7, "a a a a a a a a a a a a a"), (8, "w3 w4")]
    docs = [
        (1, long), (1, long), (2, "x " + long.upper()[:90] + " y"), (3, None), (4, ""), (5, "two-words, TWO  words!"), (6, "alone here"), (7, "ÜNÏ cödé é"), (8, "a " * 30),
        (None, "w3 w4"), (9, "nothing of it " * 50), (10, "z " * 5000 + "two words"), (11, "w0 w1 w2 w3"),
    ]
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, shingle int, id int, items int")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, words int")
    got = op.contamination(d, b).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(docs, items)))
    kept = op.without_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in kept.collect()))) == sorted(repr(x) for x, y in zip(docs, brute(docs, items)) if not y[-1])


@pytest.mark.parametrize("which", ["docs", "items"])
def test_empty(spark, which):
    d = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    if which == "docs":
        assert op.contamination(d.limit(0), b).count() == 0
    else:
        assert op.contamination(d, b.limit(0)).select("n_words", "n_hit", "contaminated").collect() == [(2, 0, False)]
