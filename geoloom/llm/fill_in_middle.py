"""Fill-in-the-middle: cut texts into prefix, middle and suffix at unit borders and put the middle last.

A unit is a run of characters that aren't blank, with the blanks before it; blanks at the end are one more.
All cutting is a pipeline of Arrow kernels over a whole run of texts:

1. a mark, a byte that no UTF-8 text holds, is put behind every unit, and splitting at it gives list arrays;
2. the lists are flattened, with the number of the parent text of each unit;
3. a unit's ordinal is its place less the place of its text's first unit;
4. ordinals below the first cut are prefix, below the second middle, the rest suffix: three filters;
5. each role's units are made lists again and joined to one piece per text.

The cuts of a text with n units come from two numbers of a seeded hash of its id, each mod n + 1, so a text is cut
alike wherever and whenever it is read. Two more numbers choose the form: `plain` leaves the text alone; `psm` is
<P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle. A text that is empty or holds one of the three
marks stays plain, so `restored` finds the text again from output and form alone.

A batch is worked through in runs of about 8 MB (a longer text is a run of its own), so memory follows the longest
text and not the batch. There is no shuffle.

Edge cases: a null text is an empty one. A null id counts as the empty string. Invalid UTF-8 is first made valid
(U+FFFD). Texts of blanks alone have one unit. Repeated rows give equal rows. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs, type_of

P, S, M = b"<P>", b"<S>", b"<M>"
_BYTES = pa.large_binary()
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
_END = b"\xff"
_NOTHING = pa.scalar(b"", _BYTES)


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The units of all texts, the number of each one's text, and the number of units of each text."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\0" + _END), _END)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)  # behind the last mark there may be nothing
    flat, parent = flat.filter(some), parent.filter(some)
    return flat, parent, np.bincount(parent.to_numpy(), minlength=len(texts))


def pieces(flat: pa.Array, role: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The units of one role, joined per text."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(role)), _NOTHING)


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Numbers of units, and the prefixes, middles and suffixes."""
    flat, parent, n = units(texts)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pa.array(np.cumsum(n) - n), parent))
    before, after = pc.less(ordinal, pc.take(pa.array(low), parent)), pc.greater_equal(ordinal, pc.take(pa.array(high), parent))
    roles = [(before, low), (pc.invert(pc.or_(before, after)), high - low), (after, n - high)]
    return n, [pieces(flat, role, sizes) for role, sizes in roles]


def transformed(texts: pa.Array, h: list[np.ndarray], rate: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of each text."""
    n, (prefix, middle, suffix) = cut(texts, h[0], h[1])
    marked = reduce(pc.or_, [pc.match_substring(texts, mark) for mark in (P, S, M)])
    plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(texts), 0)), pa.array(h[2] % 100 >= rate))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(h[3] % 100 < spm), "spm", "psm"))
    p, s, m = (pa.scalar(mark, _BYTES) for mark in (P, S, M))
    joined = {"psm": [p, prefix, s, suffix, m, middle], "spm": [s, suffix, p, prefix, m, middle]}
    as_psm, as_spm = (pc.binary_join_element_wise(*joined[k], _NOTHING) for k in ("psm", "spm"))
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), as_spm, as_psm))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form.cast(pa.string()), *chars, output.cast(pa.large_string())]


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output. rate: percent transformed; spm: percent of these in that form."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    numbers = F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))
    whole = F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).cast("binary")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").flatten().to_numpy().reshape(-1, 4).T
            for first, run in runs(batch.column("text").to_pylist(), 8 << 20):
                own = slice(first, first + len(run))
                cols = transformed(pa.array(run, _BYTES), [x[own] for x in h], rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column("id")[own], *cols], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(doc_id).alias("id"), numbers.alias("h"), whole.alias("text"))
    out = rows.mapInArrow(of_batches, f"id {type_of(docs, doc_id)}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", doc_id)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form."""
    at = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*(F.get(at, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u
  FROM documents),
k AS (
  SELECT doc_id, t, u, len(u) n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') mid, array_to_string(u[greatest(a, b) + 1:], '') suf
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) output_sha256,
  sha256(t) restored_sha256
FROM p
"""
