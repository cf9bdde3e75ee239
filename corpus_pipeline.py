"""From raw documents to token ids: five stages, each a corpus operator, each written as Parquet and read by the next.

1. language ID: documents whose language cannot be told go: texts without a letter, and longer ones far from every language's codeword.
2. near-dedup: one document of each group of near-duplicates (Jaccard 0.8 of 5-word shingles) stays, the smallest doc_id.
3. substring dedup: passages of 20 words or more that occur earlier are cut from texts.
4. benchmark decontamination: words of benchmark windows are cut from texts.
5. SentencePiece: every text left is encoded, with the scores of its n best segmentations, and decoded again.

All but the last return the columns of documents. A text that cuts have emptied stays as an empty one, so no later stage has to know of it.

A null text has no language and goes in the first stage. Rows without a doc_id pass every stage but are never dropped as copies. Rows that
repeat a doc_id with one text become one row in the second stage; with several texts each goes by its own. Further columns, whatever
their names, pass through all stages but the last. Empty tables pass through all of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselake.llm import decontaminate, langid, near, pieces, substrings
from bourselake.llm.common import Scratch, shared_folder, small_batches, table

MODEL = "piece_bpe_32k.model"
#: No SQL: hashes, codes and the vocabulary's lattice are beyond it. Tested against brute force.
ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars, where it is there, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _recount(substrings.without_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _recount(decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encoded(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, ids, n_tokens, n_best_scores, decoded. What the stages before have written is deleted in the end."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as stages:
        for _, stage in STAGES[:-1]:
            docs = stages.written(stage(spark, docs, sf_dir), "stage")
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
