from geoloom.llm import line_dedup as op


def test_sql(spark, data, same):
    same(op.op2_line_dedup(spark, data), op.OP2_SQL)


def test_edges(spark):
    passage = "\n".join(f"line number {i} of a passage that many share" for i in range(30))
    docs = [
        (1, "head\n" + passage), (2, "an inserted line\nanother\n" + passage + "\ntail one\ntail two"), (3, passage), (4, None), (5, ""), (6, "one line only"), (7, "one line only"),
        (8, "\n\n\n\n"), (9, "\n\n\n\n"), (10, "x\ny"), (10, "x\ny"), (11, "x\ny"), (None, "x\ny"), (12, "only\nhere"),
    ]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, places int")
    rows = op.without_repeated_chunks(df).collect()
    out = {(r.doc_id, d): r.text for r in rows for d in [r.doc_id]}
    assert len(rows) == len(docs) and all(r.places == 7 for r in rows)
    assert out[1, 1] == docs[0][1] and out[4, 4] is None and out[5, 5] == "" and out[6, 6] == out[7, 7] == "one line only"
    assert out[8, 8] == out[9, 9] == "\n\n\n\n" and out[12, 12] == "only\nhere"
    # shifted by two lines, the passage is found again, but for what touches its ends
    left = out[2, 2].split("\n")
    assert {"an inserted line", "another", "tail one", "tail two"} <= set(left) and len(left) < 16
    assert len(out[3, 3].split("\n")) < 10
    assert [r.text for r in rows if r.doc_id == 10] == ["x\ny", "x\ny"] and out[11, 11] == "" and out[None, None] == ""
    assert op.without_repeated_chunks(df.limit(0)).count() == 0


def test_no_python_in_plan(spark, data):
    df = op.without_repeated_chunks(spark.read.parquet(f"{data}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_passages_between_other_lines(spark):
    """Whole passages go, of two lines on or of one line of over 50 words; short lines and single repeated ones stay."""
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + f" {rng.random()}"
    passages = [[line(30) for _ in range(k)] for k in (2, 3, 5, 9)] + [[line(60)]]
    short = line(12)
    rows = []
    for i in range(40):
        p = passages[i % 5]
        rows.append((i, "\n".join([*(line(9) for _ in range(rng.randrange(3))), line(8), *p, line(8), short, line(7)])))
    out = {r.doc_id: r for r in op.without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        left, had = out[i].text.split("\n"), t.split("\n")
        gone = [] if i < 5 else passages[i % 5]
        assert left == [x for x in had if x not in gone]
        assert out[i].n_removed > 0 or i < 5


def test_very_long_text(spark):
    body = "\n".join(f"line {i} of a long text" for i in range(20_000))
    df = spark.createDataFrame([(1, body), (2, "first\n" + body)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in op.without_repeated_chunks(df).collect()}
    assert rows == {1: body, 2: "first"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, 6, "k"), (2, "a\nb", 5, 6, "k")], "doc_id long, text string, n_chunks long, hash long, key string")
    rows = {r.doc_id: r for r in op.without_repeated_chunks(df).collect()}
    assert rows[1].text == "a\nb" and rows[2].text == "" and rows[2].n_chunks == 1 and rows[2].hash == 6 and rows[2].key == "k"
