from collections import Counter
from itertools import permutations

import numpy as np

from geoloom.llm import filter_audit as op

BLANKS = " \t\n\v\f\r"


def words(t):
    for b in BLANKS[1:]:
        t = t.replace(b, " ")
    return [w for w in t.split(" ") if w]


def brute(docs, labels):
    flags = {}
    for k, (i, t, _) in enumerate(docs):
        t = t or ""
        w = words(t)
        again = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        flags[k] = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in t for c in "#$%&*|"), again]
    rows = {}
    for part in {s or "" for *_, s in docs}:
        own = [k for k, (*_, s) in enumerate(docs) if (s or "") == part]
        shapley = Counter()
        for order in permutations(range(5)):
            for step in range(5):
                i = order[step]
                stay = [k for k in own if not any(flags[k][j] for j in order[:step])]
                gone = [k for k in stay if flags[k][i]]
                shapley[i] += len(gone)
                label = lambda k, c: any(x == docs[k][0] and x is not None and y[c] == 1 for x, *y in labels)
                rows[part, "".join("ABCDE"[j] for j in order), step + 1] = [
                    len(stay) - len(gone), len(gone), sum(flags[k][i] for k in own) - len(gone), sum(flags[k][i] and sum(flags[k]) == 1 for k in own), sum(label(k, 0) for k in gone), sum(label(k, 1) for k in gone),
                ]
        for order in permutations(range(5)):
            for step in range(5):
                rows[part, "".join("ABCDE"[j] for j in order), step + 1].append(shapley[order[step]])
    return rows


DOCS = [
    (1, None, "a"), (2, "", "a"), (3, "", None), (3, "", None), (None, "", "b"), (None, "same text", "b"), (5, "same text", "b"), (6, "same text", ""),
    (7, " ".join(f"w{i}" for i in range(200)), "a"), (8, " ".join(f"w{i % 99}" for i in range(200)), "a"), (9, " ".join(f"w{i % 100}" for i in range(200)), "b"),
    (10, "A" + "b" * 49, "a"), (11, "AB" + "é" * 97, "a"), (12, "AB" + "é" * 98, "a"), (13, "x\x1cy 　  z\x85", "c"), (14, "a|b", "c"), (15, "50%\t\x0b\x0c\r\nOK", "c"),
    (16, "word " * 50_000, "long"), (17, "word Word " * 150, "long"), (18, "word Word " * 150, "long"), (2, "another", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (7, 1, 0), (8, 0, 1), (None, 1, 1), (16, 1, None), (16, None, 1), (99, 1, 1)]


def test_sql(spark, data, same):
    same(op.op12_filter_audit(spark, data), op.OP12_SQL)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*d, 0, "x") for d in DOCS], "doc_id long, text string, source string, flags int, part string").repartition(3)
    labels = spark.createDataFrame([(*x, 0) for x in LABELS], "doc_id long, quality int, toxic int, id int")
    flags = op.document_flags(docs)
    rows = op.interactions(flags, labels).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) and got == brute(DOCS, LABELS)
    counts = Counter((r.id, r.n_words, r.n_distinct) for r in flags.collect())
    assert counts == Counter((i, len(words(t or "")), len(set(words(t or "")))) for i, t, _ in DOCS)


def test_matrix_has_the_counts_of_words(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    matrix, terms = op.term_matrix(docs)
    assert terms.count() == terms.select("word").distinct().count()
    rows, word = matrix.collect(), {r.term: bytes(r.word).decode() for r in terms.collect()}
    assert sorted(word) == list(range(len(word))) and set(word.values()) == {w for _, t, _ in DOCS for w in words(t or "")}
    got = []
    for r in rows:
        indptr, data, indices = np.frombuffer(r.indptr, "<i4"), np.frombuffer(r["data"], "<i4"), np.frombuffer(r.indices, "<i8")
        for d, a, b in zip(r.docs, indptr, indptr[1:]):
            got.append((str(d.id), sorted((word[t], n) for t, n in zip(indices[a:b].tolist(), data[a:b].tolist()))))
    assert sorted(got) == sorted((str(i), sorted(Counter(words(t or "")).items())) for i, t, _ in DOCS)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, source string")
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert op.interactions(op.document_flags(docs), labels).count() == 0
    one = spark.createDataFrame([("k", None, None)], docs.schema)
    rows = op.interactions(op.document_flags(one), labels).collect()
    assert len(rows) == 600 and {(r.part, r.shapley) for r in rows} == {("", 120), ("", 0)}
