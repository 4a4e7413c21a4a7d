"""From raw documents to token ids: toxicity, exact copies, near copies, benchmark passages, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import bpe, chosen_path, decontaminate, exact_dedup, toxicity
from siftwork.llm.queries import tokenizer
from siftwork.llm.shared import spill

#: Bytes of an Arrow batch between an executor and its Python workers, each of which holds a batch or two: an eighth of Spark's default, as all
#: stages share an executor's memory, and workers that wait keep what they took.
BATCH_BYTES = 8 << 20


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of those here, doesn't reject.

    Each row is judged by its own text, so repeated rows and ties fare alike; null and empty texts get the score of an empty text.
    """
    _bounded(spark)
    return toxicity.clean_rows(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id. All null and empty texts are one group."""
    _bounded(spark)
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a five-word Jaccard similarity of 0.8 or more hold together: the smallest id.

    Texts without words, and rows without an id, stay.
    """
    _bounded(spark)
    return chosen_path.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are no twentieth part. Texts without words, and rows without an id, stay."""
    _bounded(spark)
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes that they decode to. A null text counts as empty and has no ids."""
    _bounded(spark)
    return bpe.encode_documents(docs, *tokenizer(), keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: A trained model and a randomised join are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(docs, "stage")
    return docs
