"""Language identification by n-gram filters that answer for all languages at once.

A text is read as its words: letters and marks, lower-cased, everything else a border. Its n-grams are all runs of
`lengths` characters in it, a border before and after each word being a character too.

A bit-sliced Bloom filter is a table of rows with one bit per language. An n-gram has `probes` rows by hashing; the
AND of these rows is the set of all languages whose filter holds it, so one look-up serves every language. A
language's filter holds the n-grams that it `has`: those that a share of its training documents has which is at
least `least` of the largest share any language has. So loans and wrong labels don't make an n-gram a language's
own, and common n-grams belong to several.

Per text and language the n-grams found are counted (a popcount of the language's bit over the text). Of N n-grams,
N * f are found by chance, f being the language's rate of false positives: the share of its set bits to the power
`probes`. What counts is (found - N * f) / (1 - f), and the language with most wins, ties to the one with more
training documents, then by name. The score is its share of the n-grams, 0 to 1.

Document counts of n-grams cover all training documents. Tasks count runs of texts before anything is shuffled, so
an n-gram is sent once per language and some million n-grams. Slices of the filter are built where the n-grams
are; what the driver gathers and sends is the filter itself, at most `max_bytes`, whatever the corpus: with more
n-grams it gets fuller, and the correction stronger. The names of the learned languages are collected.

Edge cases: a null text, or one without letters, is `und` with score 0, and so is every text if nothing was
learned. Null languages teach nothing, an empty one is a name like others. A null id isn't held out. A text with
letters none of whose n-grams is known gets the language with most training documents and score 0. Repeated rows
are predicted alike. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs, saved, type_of
from .toxicity import held_out

UNKNOWN = "und"
_BLANK = 32
_ODD = np.random.default_rng(13).integers(1 << 62, 1 << 64, 8, np.uint64) | np.uint64(1)
_BLOCK = 1 << 14  # rows of a slice
_TEXTS = 1 << 12  # of a run; a hash leaves as many low bits free as their number takes
_HIGH = np.uint64((1 << 64) - _TEXTS)


@cache
def _classes() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


@dataclass
class Grams:
    """Hashes of the n-grams of a run of texts, and of each the number of its text; how many letters the texts have."""

    code: np.ndarray
    text: np.ndarray
    letters: np.ndarray


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches of the given sizes, which may be zero."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def ngrams(texts: list[bytes], lengths: tuple[int, ...]) -> Grams:
    read = [t.decode(errors="replace").lower() for t in texts]
    size = np.fromiter(map(len, read), np.int64, len(read)) + 1
    points = np.frombuffer((" ".join(read) + " ").encode("utf-32-le"), "<u4")
    kind = _classes()[points]
    letters = _sums(kind == 2, size)
    word = kind > 0
    kept = word | np.concatenate([[False], word[:-1]])  # a border ends each word
    size = _sums(kept, size)
    seq = np.concatenate([[_BLANK], np.where(word, points, _BLANK)[kept]]).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # characters of the text from here on, without the border before
    at = np.flatnonzero(left >= min(lengths) - 1)  # an n-gram begins with the border, or character, before
    code, codes, owners = np.full(len(at), _ODD[1]), [], []
    for j in range(max(lengths)):
        code = (code ^ seq[at + j]) * _ODD[0]
        code ^= code >> np.uint64(32)
        if j + 1 in lengths:
            codes.append(code & _HIGH), owners.append(text[at])
        longer = left[at] >= max(j + 1, min(lengths) - 1)
        if not longer.all():
            at, code = at[longer], code[longer]
    return Grams(np.concatenate(codes), np.concatenate(owners), letters)


def small_runs(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of about 1 MB and of no more texts than have a number in the low bits."""
    for first, run in runs(texts, 1 << 20):
        for i in range(0, len(run), _TEXTS):
            yield first + i, run[i : i + _TEXTS]


def counted(rows: DataFrame, lengths: tuple[int, ...], at_once: int = 2_000_000) -> DataFrame:
    """(code, lang, n): in how many rows (text, lang) of a language an n-gram occurs; partial, to be summed."""

    def merged(parts: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        return keys, np.bincount(place, np.concatenate(ns), len(keys)).astype(np.int64)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def batch_of(lang: int) -> pa.RecordBatch:
            keys, n = merged(*held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), lang, np.int32)), pa.array(n)], ["code", "lang", "n"])

        for batch in batches:
            langs = batch.column("lang").to_numpy()
            for first, run in small_runs(batch.column("text").to_pylist()):
                for lang in np.unique(langs[first : first + len(run)]).tolist():
                    own = np.flatnonzero(langs[first : first + len(run)] == lang)
                    grams = ngrams([run[i] for i in own], lengths)
                    seen = np.sort(grams.code | grams.text.astype(np.uint64))
                    seen = seen[np.diff(seen, prepend=~seen[:1]) != 0] & _HIGH  # each n-gram once per text
                    starts = np.flatnonzero(np.diff(seen, prepend=~seen[:1]) != 0)
                    keys, n = seen[starts], np.diff(np.append(starts, len(seen)))
                    parts, ns = held.setdefault(lang, ([], []))
                    parts.append(keys), ns.append(n)
                    if sum(map(len, parts)) > at_once:
                        keys, n = merged(parts, ns)
                        held[lang] = [keys], [n]
                        if len(keys) > at_once // 2:
                            yield batch_of(lang)
        for lang in list(held):
            yield batch_of(lang)

    return rows.mapInArrow(of_batches, "code long, lang int, n long")


def rows_of(code: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The row of the filter, of 2 ** bits, that a probe of an n-gram reads."""
    mixed = (code ^ (code >> np.uint64(29))) * _ODD[2 + probe]
    return (mixed >> np.uint64(64 - bits)).view(np.int64)


@dataclass
class Filters:
    names: list[str]  # learned languages, most training documents first
    table: np.ndarray  # rows of bytes; language i is bit i % 8 of byte i // 8
    probes: int
    lengths: tuple[int, ...]
    chance: np.ndarray | None = None  # false positives per language

    def __post_init__(self) -> None:
        share = np.array([np.count_nonzero(self.table[:, i // 8] & (1 << i % 8)) for i in range(len(self.names))]) / len(self.table)
        self.chance = np.minimum(share, 0.999) ** self.probes

    def languages(self, code: np.ndarray) -> np.ndarray:
        """For every n-gram the bits of the languages that have it."""
        bits = len(self.table).bit_length() - 1
        found = self.table[rows_of(code, 0, bits)]
        for k in range(1, self.probes):
            found &= self.table[rows_of(code, k, bits)]
        return found

    def decide(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        grams = ngrams(texts, self.lengths)
        found = self.languages(grams.code)
        n = np.bincount(grams.text, minlength=len(texts))
        hits = np.empty((len(texts), len(self.names)))
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for k in range(found.shape[1]):
            sets = np.bincount(grams.text * 256 + found[:, k], minlength=256 * len(texts)).reshape(-1, 256)
            own = slice(8 * k, min(8 * k + 8, len(self.names)))
            hits[:, own] = (sets @ bits)[:, : own.stop - own.start]
        true = np.maximum(0, hits - n[:, None] * self.chance) / (1 - self.chance)
        best = true.argmax(1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
        some = grams.letters > 0
        return [self.names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], np.where(some, score, 0.0)


def learned(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", lengths: tuple[int, ...] = (2, 3, 4), least: float = 0.2, probes: int = 4, max_bytes: int = 16 << 20
) -> Filters | None:
    """The filters of all languages in docs; None without any text of a known language."""
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = sorted(((r["count"], r.lang) for r in rows.groupBy("lang").count().collect()), key=lambda x: (-x[0], x[1]))
    if not sizes:
        return None
    names = [name for _, name in sizes]
    number = F.element_at(F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i))), F.col("lang"))
    size = F.array(*(F.lit(float(n)) for n, _ in sizes))
    counts = counted(rows.select("text", number.alias("lang")), lengths).repartition("code").groupBy("code", "lang").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.get(size, F.col("lang"))
    shares = counts.groupBy("code").agg(F.collect_list(F.struct("lang", share.alias("share"))).alias("langs"))  # one entry a language at most
    most = F.array_max(F.transform("langs", lambda x: x["share"]))
    has = shares.select("code", F.transform(F.filter("langs", lambda x: x["share"] >= F.lit(least) * most), lambda x: x["lang"]).alias("langs"))
    has = saved(has, "ngrams")
    width = -(-len(names) // 8)
    room = max(_BLOCK, max_bytes // width)
    bits = min((max(_BLOCK, 2 * probes * has.count()) - 1).bit_length(), room.bit_length() - 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_numpy().view(np.uint64)
            langs = batch.column("langs")
            held = np.zeros((len(code), width), np.uint8)
            of = langs.flatten().to_numpy()
            np.bitwise_or.at(held, (np.repeat(np.arange(len(code)), np.diff(langs.offsets.to_numpy())), of // 8), (1 << of % 8).astype(np.uint8))
            for k in range(probes):
                row = rows_of(code, k, bits)
                cols = [pa.array((row // _BLOCK).astype(np.int32)), pa.array((row % _BLOCK).astype(np.int32)), pa.array([h.tobytes() for h in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "row", "bits"])

    def slice_of(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((_BLOCK, width), np.uint8)
        np.bitwise_or.at(out, rows["row"].to_numpy(), np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(-1, width))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [out.tobytes()]})

    slices = has.mapInArrow(spread, "block int, row int, bits binary").groupBy("block").applyInPandas(slice_of, "block int, bits binary")
    table = np.zeros(((1 << bits) // _BLOCK, _BLOCK, width), np.uint8)
    for r in slices.toLocalIterator():  # max_bytes in all
        table[r.block] = np.frombuffer(r.bits, np.uint8).reshape(_BLOCK, width)
    return Filters(names, table.reshape(-1, width), probes, lengths)


def predicted(docs: DataFrame, filters: Filters | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    if filters is None:
        return docs.select(F.col(doc_id), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # its table is at most max_bytes

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in small_runs(batch.column("text").to_pylist()):
                langs, score = sent.value.decide(run)
                yield pa.RecordBatch.from_arrays([batch.column("id")[first : first + len(run)], pa.array(langs, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(of_batches, f"id {type_of(docs, doc_id)}, lang_pred string, score double").withColumnRenamed("id", doc_id)


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: Column = held_out("doc_id", 4, 2)
    return predicted(docs, learned(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
