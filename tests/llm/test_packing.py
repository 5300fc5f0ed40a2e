import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import packing as op


def ids_of(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op.word_bpe())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def check(rows, docs, size):
    seqs = {}
    want = {}
    for (i, _), ids in zip(docs, ids_of([t for _, t in docs])):
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.setdefault((i, k), []).append((at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs), -(-sum(r.length for r in rows) // size)


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = op.op4_best_fit_packing(spark, data).collect()
    used, bound = check(rows, [(r.doc_id, r.text) for r in df.collect()], 4096)
    assert used <= bound + 1


@pytest.mark.parametrize("size", [8, 64])
def test_edges(spark, size):
    docs = [(1, None), (2, ""), (3, "It's we've 12½ ###!! ÉÀ ß Σς <|endoftext|> é"), (4, "word " * 200), (4, "word " * 200), (None, "a b"), (5, " 　 \x85tab\t")] + [(10 + i, "same length here") for i in range(300)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, length int")
    rows = op.packed(df, op.word_bpe(), size=size).collect()
    used, bound = check(rows, docs, size)
    assert used <= bound * 1.3 + 1
    assert op.packed(df.limit(0), op.word_bpe()).count() == 0


def test_letters_whose_normal_form_has_marks(spark):
    docs = [(0, "plain words"), (1, "İstanbul ve İZMİR, İ."), (2, "\u09df\u09a8 \u0958 a\u0958b"), (3, "\u0130 \u1e9e \ufb01n e\u0301t\u00e9 \u1100\u1161")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    used, bound = check(op.packed(df, op.word_bpe(), size=64).collect(), docs, 64)
    assert used <= bound + 1


def test_every_letter_encodes_as_alone():
    letters = [w for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha() for w in (s, f"a{s}b")]
    wanted = [np.array(e.ids, "<u4").tobytes() for e in op.Encoder(op.word_bpe()).tokenizer.encode_batch_fast(letters, add_special_tokens=False)]
    got = list(op.Encoder(op.word_bpe()).encode([w.encode() for w in letters]))
    assert got == wanted


def test_plan_places_every_piece():
    rng = np.random.default_rng(0)
    for counts in (rng.poisson(3, 257), rng.integers(0, 10**6, 257), np.eye(257, dtype=int)[200] * 10**9):
        counts[0] = 0
        length, rank, times, first, offset = op.plan(counts.astype(np.int64), rounds=12)
        total = np.zeros(257, np.int64)
        np.add.at(total, length, times)
        assert (total == counts).all() and (offset + length <= 256).all()
        assert len(length) < 40 * 257 * 12


def test_most_pieces_go_by_the_program(spark):
    for sf, most in (("sf0.01", 1), ("sf0.1", 0)):
        cut = op.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), op.word_bpe())
        counts = np.zeros(4097, np.int64)
        for r in cut.groupBy("length").count().collect():
            counts[r.length] = r["count"]
        found = op.by_classes(counts)
        assert found.by_program >= 0.75 * counts[:-1].sum() and not found.left.any()
        _, n, bound = op.plan_and_bound(counts)
        plain = op._Places(counts)
        plain.best_fit()
        assert found.sequences == n <= plain.sequences and n <= bound + most


def test_hot_length(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("hello world").alias("text"))
    rows = op.packed(df, op.word_bpe()).collect()
    assert len({r.sequence_id for r in rows}) == -(-2000 * 3 // 4096)


def test_configurations_with_room():
    def used(size, counts):
        table = np.zeros(size + 1, np.int64)
        table[list(counts)] = list(counts.values())
        (length, rank, times, first, offset), n, bound = op.plan_and_bound(table)
        placed = sorted((s, o, l) for l, t, f, o in zip(length, times, first, offset) for s in range(f, f + t))
        for (s, o, l), after in zip(placed, [*placed[1:], (-1, 0, 0)]):  # gapless, and within the sequence
            assert after[:2] == (s, o + l) or after[0] != s and after[1] == 0 and o + l <= size
        assert bound <= n == len({s for s, _, _ in placed})
        return n, bound

    assert used(4096, {2088: 600, 1106: 600, 1065: 600, 941: 1200}) == (900, 900)
    assert used(4096, {3000: 600, 1000: 600}) == (600, 600)
    assert used(4096, {2049: 7, 2048: 3})[0] == 9
    n, bound = used(4096, {1400: 1000, 1300: 500, 2700: 300, 700: 10})
    assert n <= 1.03 * bound
    assert used(10, {}) == (0, 0)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        op.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_runs_and_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op, "CACHED_WORDS", 3)
    texts = ["", "  ", "One two,  three\n\n", "two\x0bTWO\tfour--5's <|endoftext|> x<|endoftext|>y", "<|ENDOFTEXT|> \x1c a\x1cb", "", "wort " * 9, "don't, 'tis ROCK'N'ROLL"]
    t = Tokenizer.from_file(op.word_bpe())
    wanted = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for budget in (1, 20, 1 << 20):
        assert list(op.Encoder(op.word_bpe()).encode([x.encode() for x in texts], budget)) == wanted
