"""Best-fit packing of tokenised documents into sequences of a fixed length.

How pieces are packed depends on their lengths alone, and there are at most `size` lengths. So only the
length histogram comes to the driver, a configuration is a multiset of lengths that fits a sequence, and
the plan is a list of configurations with multiplicities:

1. Configuration linear program: lengths are grouped into classes of about equal numbers of pieces (with few
   pieces of each length, no configuration of single lengths can be used even once). Cover every class's count
   by configurations, a class counting as its largest length, using as few as possible. Multiplicative weights
   solve it approximately: a class's price starts in proportion to the length and falls exponentially with how
   far it is covered; each round prices configurations by a knapsack dynamic program over capacities and adds,
   for each class, the best configuration that has it, full or not, if no other is worth much more.
2. Rounding: fractions are rounded down, but to one at least, and the program is solved anew for what is left,
   until `share` of the pieces are placed. A configuration's slots take the longest pieces left of their
   classes, the last slot the longest of all that fits, so little room is lost. The other pieces go best-fit,
   into room that is left first, longest first, all pieces of a length at once: runs of sequences with equal room
   are kept as one, so the steps don't grow with the number of pieces. If that takes more sequences than there
   are tokens for, the program over single lengths, whose prices also give a lower bound, and best-fit
   alone are tried, too, and the plan of fewest sequences counts.
3. Every piece gets its rank among the pieces of its length, and the rank its place: the plan is a list of
   rank ranges per length, each with the first sequence and the offset.

Ranks are counted in buckets of a length, dealt by hash, and the buckets' sizes summed up before, so a
length that very many pieces share isn't ordered in one task.

Edge cases: a null text is empty; an empty text is one piece, the end id alone. Repeated rows are packed
each; so are rows with a null id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_words, runs, saved, type_of

#: A worker forgets all but the words of the texts at hand once it keeps the ids of so many.
CACHED_WORDS = 600_000
#: ASCII marks that the tokenizer keeps together and apart from letters; an apostrophe can take letters along.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, Encoder] = {}


def letters_alone(word: str) -> bool:
    """Whether a word and its normal form have no character but letters."""
    return word.isalpha() and normalize("NFC", word).lower().isalpha()


class Encoder:
    """Ids of whole texts as little-endian bytes, by way of their distinct words.

    For tokenizers that split at white space first, ignore case, and split letters from other marks, as the
    word-end BPE does (`check` refuses others). A text's ids are then those of its blank-separated words in
    turn, so the distinct words of a run of texts are encoded once and the ids put together as arrays.
    Letters and a tail of marks are encoded apart; words of letters alone many at a time, as each ends with the
    only token that can end a word. That holds if a word's normal form (NFC, lower case) is letters alone, too:
    'İ' and letters that NFC takes apart yield marks, which the tokenizer splits off; such words, and any
    others, are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.last = np.zeros(max(ends, default=0) + 1, bool)
        self.last[ends] = True
        self.known: dict[bytes, bytes] = {}
        self.check()

    def check(self) -> None:
        """Raise ValueError for a tokenizer whose ids aren't those of its words."""
        whole, parts = "Ab cd,  éf!?\n12 g'h", ["ab", "cd", ",", "éf", "!?", "12", "g'h"]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if not self.last.any() or ids(whole) != [i for p in parts for i in ids(p)]:
            raise ValueError("this tokenizer doesn't encode word by word")

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """One encoder for all tasks of a worker."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    def _letters(self, words: list[bytes], at_once: int = 2000) -> Iterator[bytes]:
        """Ids of words of letters alone."""
        for i in range(0, len(words), at_once):
            (ids,) = self._encoded([b" ".join(words[i : i + at_once]).decode()])
            raw, begin = ids.tobytes(), 0
            for end in (4 * (np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1)).tolist():
                yield raw[begin:end]
                begin = end

    def _any(self, words: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(words), 2000):
            yield from (ids.tobytes() for ids in self._encoded([w.decode(errors="replace") for w in words[i : i + 2000]]))

    def learn(self, words: list[bytes]) -> None:
        """Add the ids of words, each with a blank at its end, to those known."""
        known, cores, other, parts = self.known, [], set(), set()
        for w in words:
            word = w[:-1]
            core = word.rstrip(_TAIL)
            if core.isalpha() or core and letters_alone(core.decode(errors="replace")):  # bytes.isalpha() is of ASCII
                low, tail = core.lower(), word[len(core) :]
                if low not in known:
                    parts.add(low)
                if tail and tail not in known:
                    other.add(tail)
                cores.append((w, low, tail))
            else:
                other.add(w)
        letters, rest = list(parts), list(other)
        known.update(zip(letters, self._letters(letters), strict=True))
        known.update(zip(rest, self._any(rest), strict=True))
        known.update((w, known[c] + known[t] if t else known[c]) for w, c, t in cores)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            get = self.known.get
            self.known = {w: ids for w in words if (ids := get(w)) is not None}
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[bytes], budget: int = 16 << 20) -> Iterator[bytes]:
        for _, run in runs(texts, budget):
            yield from self._run(run)

    def _run(self, texts: list[bytes]) -> Iterator[bytes]:
        joined = b" ".join(texts) + b" "
        # the tokenizer knows special tokens before it ignores case; without any, fewer distinct words
        words, place, n_words = distinct_words(joined if b"<|" in joined else joined.lower(), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        if not len(place):
            yield from (b"" for _ in texts)
            return
        found = self.ids_of(words.to_pylist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        first, n = (np.cumsum(length) - length)[place], length[place]
        at = np.cumsum(n)
        raw = ids[np.arange(at[-1]) + np.repeat(first - (at - n), n)].tobytes()
        stop = 4 * np.concatenate([[0], at])[np.cumsum(n_words)]
        begin = 0
        for e in stop.tolist():
            yield raw[begin:e]
            begin = e


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Texts whose ids and end exceed `size` are cut into pieces of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer)
        last, step = array("I", [end]).tobytes(), 4 * size
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for n, ids in enumerate(encoder.encode(texts)):
                ids += last
                rows += [(n, at // step, at // 4, len(part := ids[at : at + step]) // 4, crc32(part)) for at in range(0, len(ids), step)]
            n, *cols = zip(*rows) if rows else ((),) * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = [batch.column("id").take(pa.array(n, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(cut, f"id {type_of(docs, doc_id)}, piece int, start long, length long, ids_crc32 long")


def _knapsack(prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity the best total price, and the length to take first (0: none). prices[l]: of length l, 0 if not on offer."""
    lengths = np.flatnonzero(prices)[::-1]  # of equal gains the longest piece: fewer of one length in a configuration
    price = prices[lengths]
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        fit = np.searchsorted(-lengths, -c)
        if fit < len(lengths):
            gain = best[c - lengths[fit:]] + price[fit:]
            i = int(gain.argmax())
            best[c], take[c] = gain[i], lengths[fit + i]
    return best, take


def configurations(counts: np.ndarray, *, rounds: int = 120, eta: float = 3.0, most: float = 0.1) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Configurations ((length, times), ...) and fractions that cover counts[l] pieces of each length l as far as they can; and a bound.

    A configuration may leave room. In each round those count whose price is the best one's, or less by a part
    that grows as long as rounds add little, up to `most`. Fractions never cover a length beyond its count, so
    they can be rounded one by one. The bound is the dual one: prices under which no configuration is worth
    more than 1 give, summed over all pieces, a number of sequences that no packing goes below.
    """
    size = len(counts) - 1
    lengths = np.flatnonzero(counts)
    covered = np.zeros(size + 1)
    fractions: dict[tuple[tuple[int, int], ...], float] = {}
    bound = allowed = 0.0
    for _ in range(rounds):
        share = np.minimum(covered[lengths] / counts[lengths], 1)
        if not len(lengths) or share.min() >= 1:
            break
        prices = np.zeros(size + 1)
        prices[lengths] = np.where(share < 1, lengths / size * np.exp(-eta * share), 0)
        best, take = _knapsack(prices, size)
        bound = max(bound, float(counts @ prices / best[size]))
        take = take.tolist()
        left = (counts - covered).tolist()
        before = sum(left)
        for first in lengths[::-1].tolist():
            if prices[first] + best[size - first] < (1 - allowed) * best[size] * (1 - 1e-12):
                continue
            used, room = {first: 1}, size - first
            while room and (l := take[room]):
                used[l] = used.get(l, 0) + 1
                room -= l
            x = min(1.5 * counts[first] / rounds, *(left[l] / n for l, n in used.items()))
            if x <= 1e-9:
                continue
            key = tuple(sorted(used.items(), reverse=True))
            fractions[key] = fractions.get(key, 0) + x
            for l, n in used.items():
                left[l] -= x * n
        added = before - sum(left)
        covered = counts - np.array(left)
        covered[np.array(left) < 1e-9 * counts] = counts[np.array(left) < 1e-9 * counts]
        if added * rounds < before:
            if allowed >= most:
                break
            allowed = min(most, max(2 * allowed, 1 / size))
    return fractions, bound


class _Places:
    """Rank ranges that place pieces, and what is left to place."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts) - 1
        self.left = counts.copy()
        self.used = np.zeros(len(counts), np.int64)  # ranks given out
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # runs of open sequences (first, number) by the room they have
        self.sequences = 0

    def add(self, l: int, times: int, first: int, offset: int) -> None:
        self.rows.append((l, int(self.used[l]), times, first, offset))
        self.used[l] += times
        self.left[l] -= times

    def place(self, config: tuple[tuple[int, int], ...], times: int) -> None:
        offset = 0
        for l, n in config:
            for _ in range(n):
                self.add(l, times, self.sequences, offset)
                offset += l
        if offset < self.size:
            self.rooms.setdefault(self.size - offset, []).append((self.sequences, times))
        self.sequences += times

    def best_fit(self) -> None:
        """Place what is left, longest first, many pieces of a length at once, each where the least room remains."""
        rooms, size = self.rooms, self.size
        open_rooms = sum(1 << r for r in rooms)  # bit r is set if a sequence has room r
        for l in range(size, 0, -1):
            while n := int(self.left[l]):
                if fit := open_rooms >> l:
                    room = l + (fit & -fit).bit_length() - 1
                    first, run = rooms[room].pop()
                else:
                    room, first, run = size, self.sequences, -(-n // (size // l))
                    self.sequences += run
                times = min(n, run)
                self.add(l, times, first, size - room)
                if run > times:
                    rooms.setdefault(room, []).append((first + times, run - times))
                if room < size and not rooms[room]:
                    del rooms[room]
                    open_rooms &= ~(1 << room)
                elif run > times:
                    open_rooms |= 1 << room
                if room > l:
                    rooms.setdefault(room - l, []).append((first, times))
                    open_rooms |= 1 << (room - l)


def length_classes(counts: np.ndarray, classes: int) -> dict[int, list[int]]:
    """Lengths in classes of about equal numbers of pieces, by the largest length of each, in falling order. Full sequences aren't in any."""
    lengths = np.flatnonzero(counts[:-1])[::-1]
    place = np.cumsum(counts[lengths]) - counts[lengths]
    number = place * classes // max(1, int(counts[lengths].sum()))
    found: dict[int, list[int]] = {}
    for same in np.split(lengths, np.flatnonzero(np.diff(number)) + 1):
        if len(same):
            found[int(same[0])] = same.tolist()
    return found


class _Slots(_Places):
    """Pieces put into the slots of configurations over classes of lengths."""

    def __init__(self, counts: np.ndarray, classes: dict[int, list[int]]):
        super().__init__(counts)
        self.classes = classes
        self.there = sum(1 << int(l) for l in np.flatnonzero(self.left))  # bit l is set if a piece of length l is left
        self.by_program = 0

    def add(self, l: int, times: int, first: int, offset: int) -> None:
        super().add(l, times, first, offset)
        if not self.left[l]:
            self.there &= ~(1 << l)

    def in_class(self) -> np.ndarray:
        """How many pieces are left, by class."""
        out = np.zeros(self.size + 1, np.int64)
        for largest, lengths in self.classes.items():
            out[largest] = self.left[lengths].sum()
        return out

    def fill(self, config: tuple[tuple[int, int], ...], times: int) -> int:
        """Fill up to `times` sequences: all slots but the last with the longest pieces left of their class, the last with the longest of all that fits. Returns how many."""
        slots = [c for c, n in config for _ in range(n)]
        done = 0
        while done < times:
            need: dict[int, int] = {}
            chosen, room = [], self.size
            for c in slots[:-1]:
                l = next((x for x in self.classes[c] if self.left[x] > need.get(x, 0)), None)
                if l is None:
                    return done
                need[l] = need.get(l, 0) + 1
                chosen.append(l)
                room -= l
            fits = self.there & ((1 << (room + 1)) - 1)
            while fits and self.left[last := fits.bit_length() - 1] <= need.get(last, 0):
                fits &= ~(1 << last)
            if fits:
                chosen.append(last)
                need[last] = need.get(last, 0) + 1
                room -= last
            elif not chosen:
                return done
            run = min(times - done, *(int(self.left[l]) // n for l, n in need.items()))
            offset = 0
            for l in chosen:
                self.add(l, run, self.sequences, offset)
                offset += l
            if room:
                self.rooms.setdefault(room, []).append((self.sequences, run))
            self.sequences += run
            self.by_program += run * len(chosen)
            done += run
        return done


def by_classes(counts: np.ndarray, *, classes: int = 128, share: float = 0.8, rounds: int = 120, solved: int = 3) -> _Slots:
    """A plan of the program over classes of lengths, rounded: `share` of the pieces are put into configurations, the others fill what room these leave."""
    found = _Slots(counts, length_classes(counts, classes))
    if counts[-1]:
        found.place(((len(counts) - 1, 1),), int(counts[-1]))
    rest = int((1 - share) * int(found.left.sum()))
    for n in range(solved):
        if int(found.left.sum()) <= rest:
            break
        some, _ = configurations(found.in_class(), rounds=rounds if not n else max(1, rounds // 3))
        for config, x in sorted(some.items(), key=lambda x: (-x[1], x[0])):
            if int(found.left.sum()) <= rest:
                break
            found.fill(config, max(1, int(x)))
    found.best_fit()
    return found


def by_lengths(counts: np.ndarray, rounds: int = 120) -> tuple[_Places, int]:
    """A plan of the program over single lengths, rounded as long as that places a good part; and a lower bound of the number of sequences."""
    size = len(counts) - 1
    found, bound, first = _Places(counts), 0, True
    if counts[size]:
        found.place(((size, 1),), int(counts[size]))
    while (before := int(found.left.sum())) > 0:
        some, least = configurations(found.left, rounds=rounds)
        if first:
            first, bound = False, int(counts[size]) + int(np.ceil(least * (1 - 1e-9)))
        for config, x in sorted(some.items(), key=lambda x: (-x[1], x[0])):
            if times := min(int(x + 0.5), *(int(found.left[l]) // n for l, n in config)):
                found.place(config, times)
        placed = before - int(found.left.sum())
        if not placed or 4 * placed < before:
            break
    found.best_fit()
    return found, bound


def plan_and_bound(counts: np.ndarray, rounds: int = 120) -> tuple[tuple[np.ndarray, ...], int, int]:
    """Rank ranges (length, first rank, number, first sequence, offset), by length and rank; the number of sequences; a lower bound of it.

    counts[l]: pieces of length l, for l from 0 to the sequence's size. Of the plans over classes, over single
    lengths, and by best fit alone that of fewest sequences counts, the first one among equals; once one needs no
    more sequences than there are tokens for, the rest aren't made.
    """
    size = len(counts) - 1
    bound = -(-int(counts @ np.arange(size + 1)) // size)
    found: _Places = by_classes(counts, rounds=rounds)
    if found.sequences > bound:
        other, least = by_lengths(counts, rounds)
        bound = max(bound, least)
        plain = _Places(counts)
        plain.best_fit()
        found = min(found, other, plain, key=lambda p: p.sequences)
    return tuple(np.array(sorted(found.rows), np.int64).reshape(-1, 5).T), found.sequences, bound


def plan(counts: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, ...]:
    """The rank ranges of `plan_and_bound`: they place every piece, gapless."""
    return plan_and_bound(counts, rounds)[0]


def pack(pieces_: DataFrame, *, size: int = 4096, per_bucket: int = 50_000) -> DataFrame:
    """pieces_ (id, piece, length, ...) with sequence_id and offset. pieces_ is read several times and should be a table."""
    n = pieces_.count()
    buckets = max(8, n // per_bucket)
    cell = F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int")
    cells = pieces_.groupBy("length", cell.alias("bucket")).count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = saved(cells.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "buckets")
    counts = np.zeros(size + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `size` rows
        counts[r.length] = r.n
    spark = pieces_.sparkSession
    ranges = spark.sparkContext.broadcast(plan(counts))  # its size depends on `size`, not on the data
    shift = 1 << 40

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, offset = ranges.value
        key = length * shift + rank
        for batch in batches:
            l, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, l * shift + r, "right") - 1
            kept = batch.drop_columns(["rank"])
            out = [*kept.columns, pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(out, [*kept.schema.names, "sequence_id", "offset"])

    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece"))
    ranked = pieces_.withColumn("bucket", cell).withColumn("rank", own.cast("long") - 1).join(cells.drop("count"), ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(places, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """Tokenise and pack: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, tokenizer, doc_id=doc_id, text=text, size=size, end=end), "pieces")
    return pack(cut, size=size).withColumnRenamed("id", doc_id)


def word_bpe() -> str:
    """The path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
