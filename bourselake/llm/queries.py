"""The queries of the numbered operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, decontaminate, langid, lm, oracles, pieces, resample, sharding, simhash, substrings, token_counts, token_files, variants
from .common import shared_folder, table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
#: Words that a worker remembers where it has nothing else to hold: time only, results are the same.
PIECE_CACHE = 600_000


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return token_files.digests(spark, path)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(spark, table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), cache=PIECE_CACHE)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language_id, op2_sharding, op3_token_files, op4_lm_scores, op5_token_counts, op6_substrings, op7_simhash, op8_ann, op9_sentencepiece, op10_decontaminate)
    new = (op11_importance_resampling, op12_byte_bpe, op13_spelling_variants)
    return {f.__name__: f for f in (*named, *new, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_substrings": oracles.SUBSTRINGS, "op10_decontaminate": oracles.DECONTAMINATE, "op11_importance_resampling": oracles.RESAMPLE, "op13_spelling_variants": oracles.VARIANTS}
