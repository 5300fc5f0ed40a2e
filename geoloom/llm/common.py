"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: For bytes.translate: A-Z become a-z, every ASCII byte that is neither letter nor digit a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, if it is unset, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: its rows are then computed once, and outlive executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def type_of(df: DataFrame, name: str) -> str:
    """The SQL type of a column, for the schema of a function on Arrow batches."""
    return df.schema[name].dataType.simpleString()


def runs(texts: list[bytes | None], budget: int = 16 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) of about `budget` bytes, each with the number of its first, so that what a run needs stays small."""
    first, run, n = 0, [], 0
    for t in texts:
        run.append(t or b"")
        n += len(run[-1]) + 1
        if n >= budget:
            yield first, run
            first, run, n = first + len(run), [], 0
    if run:
        yield first, run


def distinct_words(joined: bytes, sizes: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct blank-separated words, each with one blank at its end; the place among them of every word; the number of words of each text.

    joined: texts, each followed by a blank; sizes: their numbers of bytes, with that blank.
    """
    read = np.frombuffer(joined, np.uint8)
    blank = _BLANK[read]
    end = blank.copy()  # the blank after a word
    end[0], end[1:] = False, blank[1:] & ~blank[:-1]
    n_words = np.add.reduceat(end, np.cumsum(sizes) - sizes, dtype=np.int64)
    kept = ~blank | end
    read, end = read[kept], end[kept]
    read[end] = 32
    offsets = np.concatenate([[0], np.flatnonzero(end) + 1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(read)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), n_words
