"""A training corpus from raw documents: five stages of the operators in barloom.llm, each over all rows the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Rows with nulls, empty texts and repeated
rows are handled as each operator's docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, fm_index, minhash, piece_codec, quality
from barloom.llm.common import documents, shared_dir


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of texts that may have been cut."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, percent=80, n=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(fm_index.without_earlier(docs, window=50))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, max_coverage=0.5))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids and what they decode to."""
    coded = piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL has no expression for the last stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
