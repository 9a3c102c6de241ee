"""Queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagedrift.llm import bpe, chat_format, decontam, fingerprint, html_extract, line_dedup, near_dup, oracle, quality, sharding, toxicity
from pagedrift.llm.common import table

SHARDS = 16


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preferences(chat_format.swapped_answers(table(spark, sf_dir, "conversations")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_html_extract, op3_quality, op4_rendezvous, op5_decontaminate, op6_near_dup, op7_preference, op8_toxicity, op9_bpe, op10_winnowing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": oracle.OP1, "op4_rendezvous": oracle.op4(SHARDS), "op5_decontaminate": oracle.OP5, "op6_near_dup": oracle.OP6, "op7_preference": oracle.OP7, "op9_bpe": oracle.op9(public_tokenizers.path("byte_bpe_50k.tiktoken")), "op10_winnowing": oracle.OP10}
