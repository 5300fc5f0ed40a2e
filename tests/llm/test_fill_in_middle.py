import hashlib
import re

from pyspark.sql import functions as F

from geoloom.llm import fill_in_middle as op

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    u = UNIT.findall(text)
    h = [int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:low], u[low:high], u[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_sql(spark, data, same):
    same(op.op11_fill_in_middle(spark, data), op.OP11_SQL)


def test_against_brute_force(spark):
    texts = [
        "", " ", "\n \t", "a", " a", "a ", "one two  three\n\nfour ", "ü é x  y", "<P>", "a <S> b", "x<M", "<" * 500 + "P>", "a<P b S> <", "\x00 \x0b\x0c \x1c z", "😀 😀😀 " * 50,
        "word " * 60_000, "x" * 300_000, "< P> <S <M>", None,
    ]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts * 12)] + [(3, "a", "clash", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    for options in ({}, {"seed": 7, "rate": 100, "spm": 50}):
        out = op.fill_in_middle(df, **options).withColumn("again", op.restored(F.col("output"), F.col("form"))).collect()
        got = sorted((r.doc_id, r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in out)
        want = sorted((i, n, f, str(a), str(b), o) for i, t, *_ in rows for n, f, a, b, o in [brute(i, t or "", **options)])
        assert got == want
        text = {i: t or "" for i, t, *_ in rows}
        assert all(r.again == text[r.doc_id] for r in out)
        assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_other_ids_and_empty_table(spark):
    df = spark.createDataFrame([("k1", "some words of text", 1), (None, "more words", 2)], "name string, body string, text int")
    rows = {r.name: r for r in op.fill_in_middle(df, doc_id="name", text="body", rate=100).collect()}
    for name, body, _ in df.collect():
        assert tuple(rows[name])[1:] == brute(name or "", body, rate=100)
    assert op.fill_in_middle(df.limit(0), doc_id="name", text="body").count() == 0
    bad = df.limit(1).select("name", F.expr("cast(X'61ff2062' AS string)").alias("body"))
    (r,) = op.fill_in_middle(bad, doc_id="name", text="body", rate=0).collect()
    assert (r.n, r.output) == (2, "a� b")
