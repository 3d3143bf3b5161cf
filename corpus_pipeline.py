"""A pre-training corpus from raw documents: five operators in a row.

Low-quality documents go, then exact copies, then near copies; secrets are removed
from what is left, and the rest is packed into training sequences. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Each stage's result is written as Parquet and read again for the next, and
deleted when that one stands.

In every stage null and empty texts, repeated rows, rows without an identifier, empty
tables and further columns of any name are taken: the quality stage judges a null or
empty text by its (all zero) statistics; exact dedup keeps one row of the empty texts, nulls
among them; near copies keep every text without words and every row without an identifier;
the secrets stage leaves them as they are; packing gives them the end token alone. An empty
table stays empty with its columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reprolens.llm import exact_dedup, jaccard, packing, quality, secret_scan
from reprolens.llm._common import remove, shared_dir, table
from reprolens.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, trained on four fifths of the labels, does not reject."""
    # texts go to Python in small batches: the default of 10,000 rows takes hundreds of megabytes
    # beside the heap of an executor
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, str(min(int(spark.conf.get(batch)), 2000)))
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest doc_id."""
    return exact_dedup.deduplicate(docs, keep="min")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 on 5-word shingles connect."""
    return jaccard.one_of_each(docs, k=5, share=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced by a mark."""
    words = secret_scan.vocabulary_words(vocabulary("word_bpe_49k.json"))
    return secret_scan.redact(docs, secret_scan.train(spark, words=words))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1), capacity=4096)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: a trained classifier, a forest and a packing heuristic; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
