import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import toxicity as op


def made(n, seed):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randrange(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w[rng.randrange(len(w))] = "zorgl" + rng.choice(["", "ig", "en", "st", "atz", "ung"])
        rows.append((i, " ".join(w).title() + ".", int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(900, 1)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = op.toxicity(docs, labels).collect()
    truth = {i: x for i, _, x in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    # held-out labels have no part in it
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in op.toxicity(docs, other).collect()} == {r.doc_id: r.score for r in got}


def made_model(spark, toxic, ordinary, **options):
    rows = [(1, bytearray(t.encode())) for t in toxic] + [(0, bytearray(t.encode())) for t in ordinary]
    return op.kneser_ney(spark.createDataFrame(rows, "label int, text binary"), 0.75, **{"evidence": 9.0, "factor": 3.0} | options)


def brute_expressions(toxic, ordinary, evidence, factor):
    """Expressions with words of their own, and (n0, n1, documents) of each; b"" is the empty one."""
    texts = [(0, t) for t in ordinary] + [(1, t) for t in toxic]
    words = [(c, {w + b" " for w in t.encode().lower().split()}) for c, t in texts]
    begins = {w[:i] for _, ws in words for w in ws for i in range(1, len(w) + 1)}
    size = [len(ordinary), len(toxic)]
    all_n = [sum(len(w) for c, ws in words for w in ws if c == k) for k in (0, 1)]
    known = set()
    for b in begins:
        n, d = [0, 0], [0, 0]
        for c, ws in words:
            own = sum(w.startswith(b) for w in ws)
            n[c] += own
            d[c] += own > 0
        lr = 2 * sum(d[c] * math.log(d[c] * sum(size) / (sum(d) * size[c])) for c in (0, 1) if d[c])
        if lr >= evidence and abs(math.log((n[1] + 0.25) / (n[0] + 0.25)) - math.log(all_n[1] / all_n[0])) >= math.log(factor):
            known.add(b)
    counts = {}
    for c, ws in words:
        mine = [max((k for k in known if w.startswith(k)), key=len, default=b"") for w in ws]
        for k in mine:
            counts.setdefault(k, [0, 0, 0])[c] += 1
        for k in set(mine):
            counts[k][2] += 1
    return counts, words


def test_likelihoods_against_brute_force(spark):
    rng = random.Random(4)
    common = ["cat", "cats", "bat", "the", "they", "an", "\u00e4nd"]
    ordinary = [" ".join(rng.choice(common) for _ in range(12)) for _ in range(20)]
    toxic = [" ".join(rng.choice(common) for _ in range(8)) + rng.choice([" badly bad", " badder bad", " bads"]) for _ in range(9)]
    m = made_model(spark, toxic, ordinary)
    counts, words = brute_expressions(toxic, ordinary, 9.0, 3.0)
    assert any(k.startswith(b"ba") for k in counts)
    total = [sum(x[c] for x in counts.values()) for c in (0, 1)]
    docs = sum(x[2] + 1 for x in counts.values())
    p_c = {k: [(max(x[c] - 0.75, 0) + 0.75 * sum(y[c] > 0 for y in counts.values()) * (x[2] + 1) / docs) / total[c] for c in (0, 1)] for k, x in counts.items()}
    assert all(abs(sum(p[c] for p in p_c.values()) - 1) < 1e-9 for c in (0, 1))
    follow = np.exp(m.following)
    assert np.allclose(follow.sum(1), 1)

    def shared(begin):
        return math.prod(follow[a, b] for a, b in zip(b" " + begin[:-1], begin))

    def family(k):  # of all words that have k as their longest expression
        inner = [x for x in counts if x != k and x.startswith(k)]
        return shared(k) - sum(shared(x) for x in inner if not any(y != x and x.startswith(y) for y in inner))

    for text in ("the bad cat", "BADDEST baddies they", "unheard-of words", "", "b"):
        ws = [w + b" " for w in text.encode().lower().replace(b"-", b" ").split()]
        want = [0.0, 0.0]
        for w in ws:
            k = max((k for k in counts if w.startswith(k)), key=len)
            for c in (0, 1):
                want[c] += math.log(p_c[k][c] * shared(w) / family(k))
        got = m.likelihoods([text.encode()])[0]
        assert got[0] == len(ws) and np.allclose(got[1:], want)


def test_words_that_differ_late(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        stem = "verylongbeginning" if i % 2 else "\u043e\u0447\u0435\u043d\u044c\u0434\u043b\u0438\u043d\u043d\u043e"
        w = [stem + rng.choice(["ab", "ba", "aa"]) for _ in range(30)]
        if i % 3 == 0:
            w[5] = w[17] = stem + rng.choice(["zz", "zza", "zzb"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    got = {r.doc_id: r.predicted for r in op.toxicity(docs, docs.selectExpr("doc_id", "truth toxic")).collect()}
    assert sum(got[i] == truth for i, _, truth in rows) >= 0.99 * len(rows)


def test_scripts_without_blanks(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        t = "".join(chr(0x4E00 + rng.randrange(200)) for _ in range(60))
        if i % 3 == 0:
            t = t[:20] + "\u9f8d\u9f9c" + t[20:40] + "\u9f8d\u9f9c" + t[40:]
        rows.append((i, t, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    got = {r.doc_id: r.predicted for r in op.toxicity(docs, docs.selectExpr("doc_id", "truth toxic")).collect()}
    assert sum(got[i] == truth for i, _, truth in rows) >= 0.97 * len(rows)


def test_rare_expressions(spark):
    # three documents of 30 toxic ones share an expression; the ordinary 300 don't
    ordinary = [f"plain words about thing{i} and more" for i in range(300)]
    toxic = [f"plain words about thing{1000 + i} and more" + (" grumph" if i < 3 else "") for i in range(30)]
    m = made_model(spark, toxic, ordinary)
    n, low, high = m.likelihoods([b"plain grumph"])[0]
    assert high - low > 2
    n, low, high = m.likelihoods([b"plain unseen"])[0]
    assert abs(high - low) < 1


def test_registered_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op.op9_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, t) for i, t in labels.items() if i in got and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.9 * len(held) and sum(p > t for p, t in held) <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some text"), (3, "ünï " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = op.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score < 0.7 and r.predicted == 0 for r in rows)
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert op.toxicity(docs.limit(0), labels).count() == 0
