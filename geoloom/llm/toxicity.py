"""Toxicity by class-conditional Kneser-Ney models of words and what they begin with.

A text is read as its words, A-Z lower-cased (in scripts without blanks: every run of up to four characters).
Two models, of toxic and of ordinary documents, give the probability of every word, and a text's
likelihood under each is the product over all its words:

    P_c(word) = P_c(expression) * P(word) / P(expression)

An expression is a beginning of words, of any length, up to the whole word. Of the expressions that words of
labelled documents show, those count in which the classes differ more than chance explains (a likelihood
ratio statistic of `evidence` or more on the numbers of documents that have it, so that repetition in a text
proves nothing) and by a factor of `factor` or more, as a mere difference in topics or languages doesn't.
Every word belongs to the longest such beginning, or to the empty one. P_c(expression) is the class's count,
less an absolute discount, interpolated with a continuation count that both classes share: in how many
documents, of either class, the expression occurs. So an expression that is rare in a class has the shared
probability there, and a rare or inflected word the probability of what it begins with. P(word) is a
Kneser-Ney model of bytes, each after the byte before, that both classes share; it covers every word there
is. P_c sums to one over all words.

A document's evidence is the difference of the two log likelihoods, once per word and once per square root
of the number of words, in which chance alone would vary alike for all lengths. A logistic function of the
two, fitted on labelled documents that the counts didn't use, gives the score.

Labels of at most `max_docs` documents per class are used, those of least hashed id. Of these, three
quarters are counted and a quarter calibrates. What is sent to the executors is the list of expressions with
evidence, which that bounds, too, and the byte model, 65,536 numbers. Beginnings are told apart by 64-bit
hashes. Every document is scored over its whole text, and neither id nor label is part of that.

Edge cases: null and empty texts have no words and the score of evidence zero. A null id or label trains
nothing; contradicting labels of one id count as toxic; copies of a text are counted once. A null id isn't
held out. Repeated rows are scored alike. If one of the classes has no training document for counting or
calibration, every score is the share of toxic ones, or 0 without any. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, distinct_words, runs, saved, type_of

#: Thai, Lao, Burmese and Khmer letters, and those of Chinese and Japanese.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-鿿豈-﫿\U00020000-\U0003ffff]+")
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the factor and of its inverse
_BYTES = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64)
_BLANK = 32


def held_out(doc_id: str, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == which, F.lit(False))


def spaced(text: bytes) -> bytes:
    """A text as lower-case words with blanks between them."""
    if not text.isascii() and max(text) >= 0xE0:
        cut = lambda m: " " + " ".join(m[0][i : i + 4] for i in range(len(m[0]))) + " "
        text = _UNSPACED.sub(cut, text.decode(errors="replace")).encode()
    return text.translate(WORD_BYTES)


def _powers(n: int) -> list[np.ndarray]:
    for i, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
        while len(p := _POWERS[i]) < n:
            _POWERS[i] = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    return _POWERS


def beginnings(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every byte of words laid end to end, the hash of its word's beginning up to it."""
    up, down = (p[: len(words)] for p in _powers(len(words)))
    total = np.cumsum(_BYTES[words] * up)
    first = np.cumsum(length) - length
    before = np.concatenate([np.zeros(1, np.uint64), total])[first]
    code = (total - np.repeat(before, length)) * np.repeat(down[first], length)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(_FACTOR)
    return (code ^ (code >> np.uint64(32))).view(np.int64)


def laid_out(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words end to end, and their lengths."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def words_of(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    read = [spaced(t) for t in texts]
    return distinct_words(b" ".join(read) + b" ", np.fromiter(map(len, read), np.int64, len(read)) + 1)


def longest(code: np.ndarray, length: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For every word the place in `known` (sorted hashes) of its longest beginning there, -1 for none."""
    if not len(known) or not len(length):
        return np.full(len(length), -1)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    place = np.where(known[at] == code, np.arange(len(code)), -1)
    last = np.maximum.reduceat(place, np.cumsum(length) - length)
    return np.where(last >= 0, at[last], -1)


@dataclass
class KneserNey:
    known: np.ndarray  # hashes of expressions, sorted
    logs: np.ndarray  # for each, and last for the empty one: log P_c(expression) / P(expression), a column per class
    following: np.ndarray = field(default_factory=lambda: np.full((256, 256), -np.log(256)))  # log P(byte | byte before)
    slope: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def word_logs(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """log P_c of words, each with a blank at its end; a row per word, a column per class."""
        read, length = laid_out(words)
        first = np.cumsum(length) - length
        before = np.concatenate([[_BLANK], read[:-1]])
        before[first] = _BLANK
        shared = np.add.reduceat(self.following[before, read], first) if len(length) else np.zeros(0)
        return self.logs[longest(beginnings(read, length), length, self.known)] + shared[:, None]

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """For each text: number of words, log likelihood under the ordinary and under the toxic model."""
        words, place, n = words_of(texts)
        logs = self.word_logs(words)[place]
        so_far = np.concatenate([np.zeros((1, 2)), np.cumsum(logs, 0)])
        stop = np.cumsum(n)
        return np.hstack([n[:, None], so_far[stop] - so_far[stop - n]])

    def evidence(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per run of texts: the number of its first, the likelihoods, and the difference per word and per square root of their number."""
        for first, run in runs(texts):
            found = self.likelihoods(run)
            n = np.maximum(found[:, 0], 1)
            apart = found[:, 2] - found[:, 1]
            yield first, found, np.stack([apart / n, apart / np.sqrt(n)], 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """evidence: a row per document."""
        return 1 / (1 + np.exp(-np.clip(self.slope[0] + evidence @ np.array(self.slope[1:]), -30, 30)))


def beginning_counts(docs: DataFrame) -> DataFrame:
    """begin (hash), n0, n1: how many words of ordinary and of toxic documents begin so, each once per document; d0, d1: in how many documents. docs: label, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for first, texts in runs(batch.column("text").to_pylist()):
                for c in (0, 1):
                    found = [beginnings(*laid_out(words_of([t])[0])) for t, l in zip(texts, labels[first:]) if l == c]
                    if not found:
                        continue
                    code, times = np.unique(np.concatenate(found), return_counts=True)
                    in_texts = np.unique(np.concatenate([np.unique(f) for f in found]), return_counts=True)[1]
                    zero = np.zeros(len(code), np.int64)
                    cols = [code, *((times, zero, in_texts, zero) if c == 0 else (zero, times, zero, in_texts))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)

    names = ["begin", "n0", "n1", "d0", "d1"]
    rows = docs.select("label", "text").mapInArrow(count, "begin long, n0 long, n1 long, d0 long, d1 long")
    return rows.groupBy("begin").agg(*(F.sum(c).alias(c) for c in names[1:]))


def telling(docs: DataFrame, evidence: float, factor: float) -> np.ndarray:
    """Sorted hashes of the expressions in which the classes differ enough."""
    own = saved(beginning_counts(docs), "beginnings")
    sizes = {r.label: r["count"] for r in docs.groupBy("label").count().collect()}
    total = own.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total.n0 or not total.n1:
        return np.zeros(0, np.int64)
    n, every = F.col("d0") + F.col("d1"), float(sum(sizes.values()))
    part = lambda c: F.when(F.col(f"d{c}") > 0, F.col(f"d{c}") * F.log(F.col(f"d{c}") * every / (n * sizes[c]))).otherwise(0.0)
    apart = F.abs(F.log((F.col("n1") + 0.25) / (F.col("n0") + 0.25)) - F.lit(float(np.log(total.n1 / total.n0))))
    rows = own.where((2 * (part(0) + part(1)) >= evidence) & (apart >= F.log(F.lit(factor)))).select("begin").collect()
    return np.array(sorted(r.begin for r in rows), np.int64)


def expression_counts(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """begin, text (its bytes), n0, n1: words, each once per document, whose longest expression it is; d: documents with such words; and pairs of bytes.

    begin is null for the empty expression, whose text is empty, and in rows of pairs, which have two bytes that
    follow each other in words as text, and in n0 how often they do, in words once per document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = sent.value
            n, d, names = np.zeros((len(k) + 1, 2), np.int64), np.zeros(len(k) + 1, np.int64), {}
            pairs = np.zeros(1 << 16, np.int64)
            labels = batch.column("label").to_pylist()
            for label, text in zip(labels, batch.column("text").to_pylist()):
                read, length = laid_out(words_of([text or b""])[0])
                if not len(length):
                    continue
                code = beginnings(read, length)
                own = longest(code, length, k)
                n[:, label] += np.bincount(own % len(n), minlength=len(n))  # -1, the empty one, comes last
                d[np.unique(own)] += 1
                first = np.cumsum(length) - length
                before = np.concatenate([[_BLANK], read[:-1]]).astype(np.int64)
                before[first] = _BLANK
                pairs += np.bincount(before << 8 | read, minlength=1 << 16)
                if len(k):
                    at = np.minimum(np.searchsorted(k, code), len(k) - 1)
                    start = np.repeat(first, length)
                    for i in np.flatnonzero(k[at] == code).tolist():
                        if (x := int(at[i])) not in names:
                            names[x] = read[start[i] : i + 1].tobytes()
            seen = sorted(names)
            used = np.flatnonzero(pairs)
            begin = [*k[seen].tolist(), None, *[None] * len(used)]
            text = [*(names[x] for x in seen), b"", *(bytes(divmod(int(p), 256)) for p in used)]
            rows = [*seen, len(k)]
            zero = [0] * len(used)
            cols = [begin, text, [*n[rows, 0].tolist(), *pairs[used].tolist()], [*n[rows, 1].tolist(), *zero], [*d[rows].tolist(), *zero]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["begin", "text", "n0", "n1", "d"])

    rows = docs.select("label", "text").mapInArrow(count, "begin long, text binary, n0 long, n1 long, d long")
    return rows.groupBy("begin", "text").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d")))


def byte_model(pairs: np.ndarray, discount: float) -> np.ndarray:
    """P(byte | byte before) from counts, interpolated with the shares of bytes, and these with even ones; rows sum to one."""
    kinds = (pairs > 0).sum(0)  # after how many bytes each occurs
    one = (np.maximum(kinds - discount, 0) + discount * (kinds > 0).sum() / 256) / max(1, kinds.sum()) if kinds.any() else np.full(256, 1 / 256)
    total = pairs.sum(1, keepdims=True)
    own = np.maximum(pairs - discount, 0) + discount * (pairs > 0).sum(1, keepdims=True) * one
    return np.where(total > 0, own / np.maximum(total, 1), one)


def kneser_ney(docs: DataFrame, discount: float, evidence: float, factor: float) -> KneserNey:
    """From docs (label 0 or 1, text as binary)."""
    known = telling(docs, evidence, factor)
    rows = expression_counts(docs, known).collect()  # at most the expressions, one, and 65,536 pairs
    pairs = np.zeros((256, 256))
    found, empty = [], (0, 0, 0)
    for r in rows:
        if r.begin is not None:
            found.append((bytes(r.text), r.begin, r.n0, r.n1, r.d))
        elif not r.text:
            empty = (r.n0, r.n1, r.d)
        else:
            pairs[r.text[0], r.text[1]] = r.n0
    # an expression without words of its own says nothing
    found = sorted(f for f in found if f[2] + f[3])
    follow = byte_model(pairs, discount)
    texts = [f[0] for f in found]
    shared = []  # P of all words that begin so, by the bytes
    for t in texts:
        shared.append(float(np.prod(follow[list(b" " + t[:-1]), list(t)])))
    own, rest, open_ = list(shared), 1.0, []
    for i, t in enumerate(texts):  # sorted: what begins with an expression follows it
        while open_ and not t.startswith(texts[open_[-1]]):
            open_.pop()
        if open_:
            own[open_[-1]] -= shared[i]
        else:
            rest -= shared[i]
        open_.append(i)
    own = np.maximum(np.array([*own, rest]), 1e-300)
    n = np.array([*(f[2:4] for f in found), empty[:2]], float).reshape(-1, 2)
    d = np.array([*(f[4] for f in found), empty[2]], float) + 1
    total = np.maximum(n.sum(0), 1)
    p = (np.maximum(n - discount, 0) + discount * (n > 0).sum(0) * (d / d.sum())[:, None]) / total
    order = np.argsort([f[1] for f in found]) if found else []
    logs = np.log(p) - np.log(own)[:, None]
    return KneserNey(np.array([found[i][1] for i in order], np.int64), logs[[*order, len(found)]], np.log(follow))


def calibrated(evidence: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Intercept and slopes of a logistic regression, lightly held to zero, by Newton's method."""
    scale = np.maximum(evidence.std(0), 1e-9)
    x = np.hstack([np.ones((len(evidence), 1)), evidence / scale])
    beta, hold = np.zeros(x.shape[1]), np.array([0.0] + [1e-2] * evidence.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-6)
        step = np.linalg.solve(h, x.T @ (label - p) - hold * beta)
        step *= min(1, 4 / np.abs(step).max()) if step.any() else 1
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), *(beta[1:] / scale).tolist()


def training_docs(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, allowed: Column, max_docs: int) -> DataFrame:
    """label, text, part (0 to 3) of at most max_docs labelled documents per class, those of least hashed id. A table."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & allowed).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("order", F.xxhash64(F.col(doc_id).cast("string")))
    picked = known.where("label = 1").orderBy("order", doc_id).limit(max_docs).union(known.where("label = 0").orderBy("order", doc_id).limit(max_docs))
    rows = docs.select(F.col(doc_id), F.col(text).cast("binary").alias("text")).join(F.broadcast(picked), doc_id)
    rows = rows.select("label", "text", F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"))
    return saved(rows.dropDuplicates(), "labelled")  # copies are counted once


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    parts: int = 3,
    held_out_part: int = 1,
    max_docs: int = 20_000,
    discount: float = 0.75,
    evidence: float = 9.0,
    factor: float = 3.0,
    threshold: float = 0.7,
) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, toxic_log and ordinary_log (log likelihoods) of every document; labels of held-out ids aren't used."""
    train = training_docs(docs, labels, doc_id=doc_id, text=text, label=label, allowed=~held_out(doc_id, parts, held_out_part), max_docs=max_docs)
    seen = {(r.label, r.part == 0): r["count"] for r in train.groupBy("label", (F.col("part") == 0).alias("part")).count().collect()}
    spark = docs.sparkSession
    if all(seen.get((c, p)) for c in (0, 1) for p in (True, False)):
        model = kneser_ney(train.where("part > 0"), discount, evidence, factor)
        sent = spark.sparkContext.broadcast(model)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, found, apart in sent.value.evidence(batch.column("text").to_pylist()):
                    yield pa.RecordBatch.from_arrays([batch.column("label").slice(first, len(found)), *(pa.array(x) for x in apart.T)], ["label", "x", "y"])

        rows = train.where("part = 0").select("label", "text").mapInArrow(weigh, "label int, x double, y double").collect()  # at most max_docs of a class
        table = np.array(sorted(rows), float)
        model.slope = calibrated(table[:, 1:], table[:, 0])
    else:
        n = {c: seen.get((c, True), 0) + seen.get((c, False), 0) for c in (0, 1)}
        share = n[1] / max(1, n[0] + n[1])
        model = KneserNey(np.zeros(0, np.int64), np.zeros((1, 2)), slope=(float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 * (2 * share - 1), 0.0, 0.0))
    sent = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found, apart in sent.value.evidence(batch.column("text").to_pylist()):
                cols = [pa.array(sent.value.score(apart)), pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 2]), pa.array(found[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(found)), *cols], ["id", *names])

    names = ["score", "n_words", "toxic_log", "ordinary_log"]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    rows = rows.mapInArrow(judge, f"id {type_of(docs, doc_id)}, score double, n_words long, toxic_log double, ordinary_log double")
    out = rows.withColumnRenamed("id", doc_id)
    return out.select(doc_id, held_out(doc_id, parts, held_out_part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *names[1:])


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")
