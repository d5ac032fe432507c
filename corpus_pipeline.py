"""The corpus pipeline: each stage reads all that its predecessor kept, written as Parquet.

All stages but the last return the columns of ``documents``; the last returns
the ids of the texts that are left, encoded.

In every stage an empty table gives no rows, columns beyond those of
``documents`` are carried along up to the last stage, even where they have names
that an operator uses, and texts are taken whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.llm import bpe, decontaminate, jaccard, pii, toxicity

#: Rows and bytes of a batch that a task hands to Python at most: beside a task's heap, batches are what an executor holds.
BATCH_ROWS, BATCH_BYTES = 2_000, "8m"
#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, predicts to be toxic go.

    Null and empty texts are scored as texts without words; repeated rows go or stay together; a null id is scored like any other.
    """
    _small_batches(spark)
    model = toxicity.train(docs, runtime.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that with the smallest id.

    Null and empty texts have no links and stay; rows that repeat id and text become one; rows that share an id but are not
    linked all stay; a null id is linked with nothing and stays.
    """
    _small_batches(spark)
    return jaccard.distinct_documents(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly such passages.

    Null and empty texts have no passages and stay; each repeated row is treated alike.
    """
    _small_batches(spark)
    return decontaminate.remove(docs, runtime.table(spark, sf_dir, "benchmark")).withColumn("n_chars", _chars()).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to the names of their kinds.

    Null stays null and empty stays empty; rows are told apart by id and text, so repeated rows are masked alike.
    """
    return pii.redact(docs).withColumn("n_chars", _chars()).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, checked by decoding them: id, source, language, count, ids and digest of the decoded bytes.

    Null and empty texts have no ids; each repeated row is encoded; columns other than those named are not returned.
    """
    _small_batches(spark)
    shared = bpe.default_vocabulary(spark)
    return bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), shared).select(
        "doc_id",
        "lang",
        "source",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("text_sha256"),
    )


def _chars():
    return F.length("text").cast("bigint")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]
#: Training a classifier and merging bytes have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = runtime.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
