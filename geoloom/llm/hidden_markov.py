"""A hidden Markov language model over whole documents, and a unigram base beside it.

A text's tokens are its blank-separated words, A-Z lower-cased, and one end. All tokens of all training
documents are counted. The states emit classes of tokens: each of the `own_classes` most frequent tokens is
a class of its own, any other token, known or not, falls into one of `suffix_classes` by its last bytes, and
the end is a class. Within a class of many tokens a token has probability (count + 1) / (sum of counts +
number of tokens + 1), the last 1 for all tokens never seen. So the model is of fixed size whatever the
vocabulary, and still gives every token of the corpus its own probability.

Texts are read twice: once to count tokens, once to write every text's classes as a row of numbers. Training
is Baum-Welch on these rows: each pass runs scaled forward and backward recursions inside the tasks, adds up
expected counts, and Spark sums these over partitions by class. First come `start_passes` passes that see
another `start_parts`-th of the training documents each, then `passes` passes that see all of them; so all
that is gathered grows with the documents. Scoring runs the scaled forward recursion over every document.

A text of more than CHUNK tokens is cut into chunks. For each, the recursion from every state gives the
chunk's matrix of moves; these, multiplied in order, give the exact forward variables before each chunk and
backward variables after it. So memory doesn't grow with a text, but for its classes.

The counts of the `dictionary` most frequent tokens are sent to the executors, a number bounded by that
parameter. Rarer tokens are joined with the table of counts, as (document, token, times), and their terms
are summed up by document.

Edge cases: null and empty texts are the end token alone. Rows are scored one by one, repeated ones alike; a
null id isn't held out, and sees the full passes only. Without training documents every count is 0 and all
tokens share the end's or their suffix's class evenly. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, runs, saved, type_of

SUFFIX = 4
#: The most tokens that one recursion takes at once.
CHUNK = 4096


def held_out(doc_id: str, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == which, F.lit(False))


@dataclass
class Vocabulary:
    """Counts of frequent tokens, and how tokens fall into classes."""

    place: dict[bytes, int]  # listed tokens, most frequent first
    counts: np.ndarray  # of listed tokens
    n_own: int
    n_suffix: int
    within: np.ndarray  # log10(sum of counts + number of tokens + 1) of each suffix class
    weights: np.ndarray  # training tokens of each class
    total: int
    distinct: int

    @property
    def end(self) -> int:
        return self.n_own + self.n_suffix

    def places(self, tokens: list[bytes]) -> np.ndarray:
        """The places of tokens in the list, -1 for those that aren't listed."""
        return np.fromiter(map(self.place.get, tokens, repeat(-1)), np.int64, len(tokens))

    def classes(self, tokens: list[bytes], place: np.ndarray) -> np.ndarray:
        """The classes of tokens and of the end: a place below n_own is its token's class."""
        out = np.append(place, self.end)
        n, mask = self.n_suffix, self.n_own
        shared = np.flatnonzero((place < 0) | (place >= mask))
        out[shared] = [mask + crc32(tokens[i][-SUFFIX:]) % n for i in shared.tolist()]
        return out

    def sequence(self, tokens: list[bytes]) -> np.ndarray:
        return self.classes(tokens, self.places(tokens))


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of texts but the end, the place among them of every token, and the number of tokens of each text."""
    words, place, n = distinct_words(b" ".join(texts).lower() + b" ", np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return pc.binary_slice(words, 0, -1), place, n


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """token (binary), n: over all rows of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch.column(0).to_pylist()):
                words, place, _ = tokens_of(texts)
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(place, minlength=len(words)))], ["token", "n"])

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def at_most(counts: DataFrame, limit: int) -> int:
    """The least count such that at most `limit` tokens have it or more, on a grid of eight steps to a doubling."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(step.alias("step")).count().collect()  # at most 504 rows
    so_far, least = 0, 1 << 62
    for r in sorted(bins, reverse=True):
        so_far += r["count"]
        if so_far > limit:
            break
        least = int(np.ceil(2 ** (r.step / 8)))
        while int(np.floor(np.log2(least) * 8)) < r.step:
            least += 1
    return least


def vocabulary(counts: DataFrame, n_docs: int, *, own_classes: int, suffix_classes: int, dictionary: int) -> Vocabulary:
    """counts must be a table. The driver gets at most `dictionary` tokens and `suffix_classes` sums."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own_from, listed_from = (at_most(counts, k) for k in (own_classes, dictionary))
    listed = sorted((-r.n, bytes(r.token)) for r in counts.where(F.col("n") >= min(own_from, listed_from)).collect())
    n_own = sum(-n >= own_from for n, _ in listed)
    bucket = F.pmod(F.crc32(F.expr(f"substring(token, -least({SUFFIX}, octet_length(token)), {SUFFIX})")), F.lit(suffix_classes))
    sums = counts.where(F.col("n") < own_from).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("tokens")).collect()
    weights, tokens = np.zeros(n_own + suffix_classes + 1), np.zeros(suffix_classes)
    weights[:n_own] = [-n for n, _ in listed[:n_own]]
    for r in sums:
        weights[n_own + r.bucket], tokens[r.bucket] = r.n, r.tokens
    weights[-1] = n_docs
    within = np.log10(weights[n_own:-1] + tokens + 1)
    place = {t: i for i, (_, t) in enumerate(listed)}
    return Vocabulary(place, np.array([-n for n, _ in listed], np.int64), n_own, suffix_classes, within, weights, total + n_docs, distinct + (n_docs > 0))


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def model_from(start: np.ndarray, move: np.ndarray, emit: np.ndarray, weights: np.ndarray, strength: float = 50.0) -> Model:
    """Probabilities from expected counts, each with a little of the overall distribution."""
    overall = (weights + 1) / (weights + 1).sum()
    k = len(start)
    share = lambda x: (x + 1 / k) / (x + 1 / k).sum(-1, keepdims=True)
    return Model(share(start), share(move), (emit + strength * overall[:, None]) / (emit.sum(0) + strength))


class Packed:
    """Sequences side by side, longest first: step t holds the t-th classes of those that are longer than t."""

    def __init__(self, sequences: list[np.ndarray]):
        length = np.array([len(s) for s in sequences])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        self.width = np.searchsorted(-length, -np.arange(length[0]))  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        self.classes = np.empty(len(step), np.int64)
        self.classes[self.at[step] + np.repeat(np.arange(len(length)), length)] = np.concatenate([sequences[i] for i in self.order])

    def forward(self, m: Model, first: np.ndarray | None = None, keep: bool = False):
        """Natural log likelihoods and last forward variables in the order given; if asked, all scaled forward variables and the scales.

        first: probabilities of the states at the first token, a row per sequence; otherwise the model's start.
        """
        score, last = np.zeros(len(self.order)), np.empty((len(self.order), len(m.start)))
        alphas = np.empty((len(self.classes), len(m.start))) if keep else None
        scales = np.empty(len(self.classes)) if keep else None
        a = m.start if first is None else first[self.order]
        for t, n in enumerate(self.width):
            here = slice(self.at[t], self.at[t + 1])
            if t:
                last[n : len(a)] = a[n:]
                a = a[:n] @ m.move
            a = a * m.emit[self.classes[here]]
            c = a.sum(1)
            a /= c[:, None]
            score[:n] += np.log(c)
            if keep:
                alphas[here], scales[here] = a, c
        last[: len(a)] = a
        out, end = np.empty_like(score), np.empty_like(last)
        out[self.order], end[self.order] = score, last
        return out, end, alphas, scales

    def expected(self, m: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> float:
        """Add expected counts to start, move and emit; returns the log likelihood.

        before: for sequences that go on with a text, its forward variables so far; NaN for those that begin one.
        after: backward variables at their ends; 1 without.
        """
        k = len(m.start)
        inner = np.zeros(len(self.order), bool) if before is None else ~np.isnan(before[:, 0])
        first = np.tile(m.start, (len(self.order), 1))
        if inner.any():
            first[inner] = before[inner] @ m.move
        score, _, alphas, scales = self.forward(m, first, keep=True)
        ends = np.ones((len(self.order), k)) if after is None else after[self.order]
        gammas = np.empty_like(alphas)
        later = np.zeros_like(move)
        b, ahead = None, 0
        for t in range(len(self.width) - 1, -1, -1):
            n, here = self.width[t], slice(self.at[t], self.at[t + 1])
            own = ends[:n].copy()
            if ahead:
                own[:ahead] = b @ m.move.T
                later += alphas[here][:ahead].T @ b
            gammas[here] = alphas[here] * own
            b, ahead = m.emit[self.classes[here]] * own / scales[here, None], n
        inner = inner[self.order]
        if inner.any():
            later += before[self.order][inner].T @ b[inner]
        move += later * m.move
        start += gammas[: self.width[0]][~inner].sum(0)
        for s in range(k):
            emit[:, s] += np.bincount(self.classes, gammas[:, s], len(emit))
        return float(score.sum())


def _chunks(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence[i : i + CHUNK] for i in range(0, len(sequence), CHUNK)]


def _moves(m: Model, chunks: list[np.ndarray], at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and state before it, the distribution of states at its end, and the log likelihood of the chunk."""
    k = len(m.start)
    ends, logs = np.empty((len(chunks), k, k)), np.empty((len(chunks), k))
    for i in range(0, len(chunks), at_once):
        some = chunks[i : i + at_once]
        score, last, _, _ = Packed([c for c in some for _ in range(k)]).forward(m, np.tile(m.move, (len(some), 1)))
        ends[i : i + at_once], logs[i : i + at_once] = last.reshape(-1, k, k), score.reshape(-1, k)
    return ends, logs


def around(m: Model, texts: list[list[np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Of each text, given as its chunks: the log likelihood, the forward variables before each chunk (NaN before the first), the backward variables after each."""
    if not texts:
        return
    score, last = np.empty(len(texts)), np.empty((len(texts), len(m.start)))
    for i in range(0, len(texts), 128):
        score[i : i + 128], last[i : i + 128], _, _ = Packed([t[0] for t in texts[i : i + 128]]).forward(m)
    all_ends, all_logs = _moves(m, [c for t in texts for c in t[1:]])
    at = 0
    for total, a, text in zip(score.tolist(), last, texts):
        ends, logs = all_ends[at : at + len(text) - 1], all_logs[at : at + len(text) - 1]
        at += len(text) - 1
        before, scale = [np.full(len(a), np.nan)], []
        for end, log in zip(ends, logs):
            before.append(a)
            top = log.max()
            a = (a * np.exp(log - top)) @ end
            scale.append(top + np.log(a.sum()))
            total += scale[-1]
            a = a / a.sum()
        after = [np.ones(len(a))]
        for end, log, c in zip(ends[::-1], logs[::-1], scale[::-1]):
            after.append(np.exp(log - c) * (end @ after[-1]))
        yield total, np.array(before), np.array(after[::-1])


def likelihoods(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihoods of sequences of any length."""
    out = np.empty(len(sequences))
    long = [i for i, s in enumerate(sequences) if len(s) > CHUNK]
    out[long] = [x[0] for x in around(m, [_chunks(sequences[i]) for i in long])]
    for g in groups([s if len(s) <= CHUNK else s[:0] for s in sequences]):
        out[g] = Packed([sequences[i] for i in g]).forward(m)[0]
    return out


def expectations(m: Model, sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Add the expected counts of sequences of any length; returns their log likelihood."""
    k, total = len(m.start), 0.0
    pieces = [s for s in sequences if len(s) <= CHUNK]
    before, after = [np.full((len(pieces), k), np.nan)], [np.ones((len(pieces), k))]
    long = [_chunks(s) for s in sequences if len(s) > CHUNK]
    for chunks, (_, a, b) in zip(long, around(m, long)):
        pieces += chunks
        before.append(a), after.append(b)
    first, last = np.concatenate(before), np.concatenate(after)
    for g in groups(pieces):
        total += Packed([pieces[i] for i in g]).expected(m, start, move, emit, first[g], last[g])
    return total


def groups(sequences: list[np.ndarray], tokens: int = 300_000) -> Iterator[list[int]]:
    """Numbers of sequences of like length, without empty ones, in groups that bound memory."""
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: -len(sequences[i]))
    group: list[int] = []
    n = 0
    for i in order:
        group.append(i)
        n += len(sequences[i])
        if n >= tokens:
            yield group
            group, n = [], 0
    if group:
        yield group


def encoded(docs: DataFrame, vocab, *, doc_id: str, text: str, held: Column) -> DataFrame:
    """A table with a row per document.

    row, id, held; classes: the text's classes as bytes; n_tokens; of tokens of the dictionary and the end
    n_known, base (sum of log10(count + 1)) and own (sum of the logs of their shares in their classes);
    rare, times: its other tokens.
    """
    names = ["row", "id", "held", "classes", "n_tokens", "n_known", "base", "own", "rare", "times"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        end_count = int(v.weights[-1])
        kind = class_type(len(v.weights))
        for batch in batches:
            for first, texts in runs(batch.column("text").to_pylist(), 8 << 20):
                words, at, n = tokens_of(texts)
                tokens = words.to_pylist()
                place = v.places(tokens)
                classes = v.classes(tokens, place)  # the last is the end's
                known = np.append(place >= 0, end_count > 0)
                base = np.log10(np.append(np.where(place >= 0, v.counts[place] if len(v.counts) else 0, 0), end_count) + 1)
                shared = (classes >= v.n_own) & (classes < v.end)
                own = np.zeros(len(classes))
                own[shared] = base[shared] - v.within[classes[shared] - v.n_own]
                stop = np.cumsum(n + 1)
                start = stop - n - 1
                full = np.full(stop[-1], len(tokens))
                inner = np.ones(len(full), bool)
                inner[stop - 1] = False
                full[inner] = at
                raw, width = classes[full].astype(kind).tobytes(), kind.itemsize
                sums = [np.add.reduceat(x[full], start) for x in (known.astype(np.int64), base, own)]
                rare = np.flatnonzero(np.append(place < 0, False)[full])
                key, times = np.unique(np.searchsorted(stop, rare, "right") * len(classes) + full[rare], return_counts=True)
                of_text, word = np.divmod(key, len(classes))
                offsets = pa.array(np.searchsorted(of_text, np.arange(len(texts) + 1)).astype(np.int32))
                cols = [
                    *(batch.column(c).slice(first, len(texts)) for c in ("row", "id", "held")),
                    pa.array([raw[a * width : b * width] for a, b in zip(start.tolist(), stop.tolist())], pa.binary()),
                    *(pa.array(x) for x in (n + 1, *sums)),
                    pa.ListArray.from_arrays(offsets, words.take(pa.array(word)).cast(pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), held.alias("held"), F.col(text).cast("binary").alias("text"))
    kinds = "classes binary, n_tokens long, n_known long, base double, own double, rare array<binary>, times array<long>"
    return saved(rows.mapInArrow(encode, f"row long, id {type_of(docs, doc_id)}, held boolean, {kinds}"), "sequences")


def class_type(n_classes: int) -> np.dtype:
    return np.dtype("<u2" if n_classes <= 1 << 16 else "<u4")


def sequences_of(column: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def baum_welch(rows: DataFrame, vocab, model: Model) -> tuple[Model, float]:
    """One pass over rows with `classes`: the model from the expected counts, and the log likelihood before. Without rows the model stays."""
    spark, k = rows.sparkSession, len(model.start)
    given = spark.sparkContext.broadcast(model)
    n_classes = len(model.emit)
    kind = class_type(n_classes)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        start, move, emit, score = np.zeros(k), np.zeros((k, k)), np.zeros((n_classes, k)), 0.0
        for batch in batches:
            score += expectations(m, sequences_of(batch.column(0), kind), start, move, emit)
        used = np.flatnonzero(emit.any(1))
        # rows by class; below zero: -1 the start, -2 - i the moves from state i, -2 - k the likelihood
        label = np.concatenate([used, [-1], -2 - np.arange(k), [-2 - k]])
        table = np.vstack([emit[used], start, move, np.full(k, score / k)])
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), *(pa.array(c) for c in table.T)], ["label", *(f"s{i}" for i in range(k))])

    parts = rows.select("classes").mapInArrow(expect, "label long, " + ", ".join(f"s{i} double" for i in range(k)))
    sums = parts.groupBy("label").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).collect()  # at most classes + states + 2 rows
    emit, rest = np.zeros((n_classes, k)), {}
    for r in sums:
        if r[0] >= 0:
            emit[r[0]] = r[1:]
        else:
            rest[r[0]] = np.array(r[1:])
    zero = np.zeros(k)
    if not rest.get(-1, zero).any():
        return model, 0.0
    move = np.array([rest.get(-2 - i, zero) for i in range(k)])
    return model_from(rest[-1], move, emit, vocab.value.weights), float(rest[-2 - k].sum())


def train(rows: DataFrame, vocab, *, states: int, start_parts: int, start_passes: int, passes: int, seed: int = 5) -> Model:
    """From rows of `encoded` that aren't held out."""
    weights = vocab.value.weights
    noise = np.exp(np.random.default_rng(seed).standard_normal((len(weights), states)))
    model = model_from(np.ones(states), 9 * states * np.eye(states) + np.ones((states, states)), weights[:, None] * noise, weights)
    rows = rows.where("NOT held")
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(start_parts))
    for i in range(start_passes):
        model, _ = baum_welch(rows.where(F.col("id").isNotNull() & (part == i % start_parts)), vocab, model)
    for _ in range(passes):
        model, _ = baum_welch(rows, vocab, model)
    return model


def scored(rows: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """One row per row of `encoded`: id, held, n_tokens, n_known, base_score, score (log10)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = class_type(len(vocab.weights))
    kept = ["row", "id", "held", "n_tokens", "n_known", "base", "own"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = likelihoods(sent.value, sequences_of(batch.column("classes"), kind)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, "path"])

    kinds = f"row long, id {type_of(rows, 'id')}, held boolean, n_tokens long, n_known long, base double, own double, path double"
    paths = rows.select(*kept, "classes").mapInArrow(score, kinds)
    rare = rows.select("row", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("times").alias("times")))).join(counts, "token", "left")
    known = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("term"), known.alias("more"))
    shift = float(np.log10(vocab.total + vocab.distinct + 1))
    term = F.coalesce("term", F.lit(0.0))
    return paths.join(rare, "row", "left").select(
        "id",
        "held",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + term - F.col("n_tokens") * F.lit(shift)).alias("base_score"),
        (F.col("path") + F.col("own") + term).alias("score"),
    )


def language_model_scores(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    parts: int = 7,
    held_out_part: int = 2,
    states: int = 8,
    own_classes: int = 1 << 15,
    suffix_classes: int = 1 << 13,
    dictionary: int = 1 << 17,
    start_parts: int = 16,
    start_passes: int = 8,
    passes: int = 2,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; see the module."""
    held = held_out(doc_id, parts, held_out_part)
    learn = docs.where(~held)
    counts = saved(token_counts(learn, text), "counts")
    vocab = vocabulary(counts, learn.count(), own_classes=own_classes, suffix_classes=suffix_classes, dictionary=dictionary)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = encoded(docs, sent, doc_id=doc_id, text=text, held=held)
    model = train(rows, sent, states=states, start_parts=start_parts, start_passes=start_passes, passes=passes)
    out = scored(rows, counts, vocab, model).withColumnRenamed("id", doc_id)
    return out.select(doc_id, F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
