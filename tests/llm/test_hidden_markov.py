import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import hidden_markov as op


def random_model(states, classes, seed):
    rng = np.random.default_rng(seed)
    share = lambda x: x / x.sum(-1, keepdims=True)
    return op.Model(share(rng.random(states)), share(rng.random((states, states))), share(rng.random((states, classes))).T)


def every_path(m, seq):
    return sum(m.start[p[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[o, s] for s, o in zip(p, seq)) for p in itertools.product(range(len(m.start)), repeat=len(seq)))


def test_forward_is_exact_and_training_climbs():
    m = random_model(3, 5, 1)
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n) for n in (1, 6, 3, 1, 5)]
    got = op.Packed(seqs).forward(m)[0]
    assert got == pytest.approx([math.log(every_path(m, s)) for s in seqs])
    before = None
    for _ in range(6):
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        score = op.Packed(seqs).expected(m, start, move, emit)
        assert start.sum() == pytest.approx(len(seqs)) and emit.sum() == pytest.approx(sum(map(len, seqs))) and move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs))
        assert before is None or score >= before - 1e-9
        m, before = op.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), score


def test_long_sequences_neither_vanish_nor_stop():
    m = random_model(2, 4, 3)
    assert np.isfinite(op.Packed([np.zeros(20_000, np.int64), np.ones(1, np.int64)]).forward(m)[0]).all()


@pytest.mark.parametrize("chunk", [1, 2, 5, 100])
def test_chunks_change_nothing(monkeypatch, chunk):
    m = random_model(3, 5, 7)
    rng = np.random.default_rng(8)
    seqs = [rng.integers(0, 5, n) for n in (1, 7, 40, 13, 90, 2)]
    whole = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    score = op.Packed(seqs).expected(m, *whole)
    monkeypatch.setattr(op, "CHUNK", chunk)
    parts = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    assert op.likelihoods(m, seqs) == pytest.approx(op.Packed(seqs).forward(m)[0])
    assert op.expectations(m, seqs, *parts) == pytest.approx(score)
    for a, b in zip(whole, parts):
        assert a == pytest.approx(b)


def test_registered_query_against_brute_force(spark):
    """Counts and the base by plain Python; the model's part by a plain forward recursion over the classes."""
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op.op10_language_model(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = docs.where(~op.held_out("doc_id", 7, 2))
    counts = op.saved(op.token_counts(learn, "text"), "counts")
    n = {bytes(r.token): r.n for r in counts.collect()}
    vocab = op.vocabulary(counts, learn.count(), own_classes=1 << 15, suffix_classes=1 << 13, dictionary=1 << 17)
    sent = spark.sparkContext.broadcast(vocab)
    model = op.train(op.encoded(docs, sent, doc_id="doc_id", text="text", held=op.held_out("doc_id", 7, 2)), sent, states=8, start_parts=16, start_passes=8, passes=2)
    total, distinct = sum(n.values()) + learn.count(), len(n) + 1
    members = Counter()
    for t, c in n.items():
        k = vocab.sequence([t])[0]
        if k >= vocab.n_own:
            members[k] += c
            members[k, "kinds"] += 1
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        base = sum(math.log10((n.get(w, 0) + 1) / (total + distinct + 1)) for w in words) + math.log10((learn.count() + 1) / (total + distinct + 1))
        score, a = 0.0, model.start
        for i, w in enumerate([*words, None]):
            k = vocab.end if w is None else vocab.sequence([w])[0]
            a = (a if i == 0 else a @ model.move) * model.emit[k]
            score += math.log10(a.sum())
            a = a / a.sum()
            if w is not None and k >= vocab.n_own:
                score += math.log10((n.get(w, 0) + 1) / (members[k] + members[k, "kinds"] + 1))
        got = rows[r.doc_id]
        assert got.n_tokens == len(words) + 1 and got.train_tokens == total
        assert got.base_score == pytest.approx(base) and got.score == pytest.approx(score, rel=1e-6)


def test_base_and_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in op.language_model_scores(docs, start_parts=2, start_passes=3, passes=1, own_classes=300, dictionary=900, suffix_classes=64).collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    end, counts = object(), Counter()
    for i, w in texts.items():
        if not out[i]:
            counts.update([*w, end])
    n, v = sum(counts.values()), len(counts)
    assert rows.keys() == texts.keys()
    for i, w in texts.items():
        w, r = [*w, end], rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b", "a a", "b c b", "c d e f g", "h i"] * 3)], "doc_id long, text string")
    one = [(i, t) for i, t in enumerate(["", *"abcdefghi", "unseen-q"])]
    counts = op.saved(op.token_counts(docs, "text"), "counts")
    vocab = op.vocabulary(counts, 15, own_classes=2, suffix_classes=1, dictionary=4)
    sent = spark.sparkContext.broadcast(vocab)
    coded = lambda df: op.encoded(df, sent, doc_id="doc_id", text="text", held=F.lit(False))
    model = op.train(coded(docs), sent, states=2, start_parts=3, start_passes=2, passes=1)
    p = {r.id: 10**r.score for r in op.scored(coded(spark.createDataFrame(one, "doc_id long, text string")), counts, vocab, model).collect()}
    # the first token is the end, one of the known words, or any unseen one
    first = op.Model(model.start, model.move, model.emit)
    after = {i: every_path(first, vocab.sequence(t.encode().split())) for i, t in one}
    share = {i: p[i] / after[i] for i, _ in one}  # the probability of the word within its class
    begin = {i: float((model.start * model.emit[vocab.sequence(t.encode().split())[0]]).sum()) for i, t in one}
    assert sum(begin[i] * share[i] for i, _ in one) == pytest.approx(1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some Text"), (4, "ünï ß " * 4000)], "doc_id long, text string")
    rows = op.language_model_scores(docs, start_parts=2, start_passes=1, passes=1).collect()
    n = {r.doc_id: r.n_tokens for r in rows}
    assert len(rows) == 5 and n == {1: 1, 2: 1, None: 3, 4: 8001} and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    assert op.language_model_scores(docs.limit(0)).count() == 0
