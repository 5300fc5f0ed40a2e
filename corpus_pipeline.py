"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import saved
from geoloom.llm.decontamination import without_contaminated
from geoloom.llm.jaccard import similar_texts
from geoloom.llm.line_dedup import without_repeated_chunks
from geoloom.llm.packing import packed, word_bpe
from geoloom.llm.quality import without_rejected
from geoloom.llm.simhash import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_rejected(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that occur before; n_chars follows the text."""
    return without_repeated_chunks(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of least doc_id.

    Linked are fingerprints that differ in at most two bits, and texts whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more.
    """
    return one_of_each(docs, similar=similar_texts(docs)).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids and their places in sequences."""
    return packed(docs, word_bpe())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = saved(docs, "stage")
    return docs
