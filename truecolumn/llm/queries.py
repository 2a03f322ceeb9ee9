"""One query per operator over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from truecolumn.llm import turns
from truecolumn.llm.additive import score_quality
from truecolumn.llm.arc import converted_pages
from truecolumn.llm.bpe import token_digests
from truecolumn.llm.common import table
from truecolumn.llm.decontaminate import contaminated
from truecolumn.llm.language import language_of_documents
from truecolumn.llm.near_dup import near_duplicates
from truecolumn.llm.packing import pack, token_ids
from truecolumn.llm.periods import run_digests
from truecolumn.llm.quality import quality_of_documents
from truecolumn.llm.secret_scan import secret_digests
from truecolumn.llm.substrings import removed_words
from truecolumn.llm.toxicity import score_documents


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_pages(spark, table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_minhash_near_dup": op1_minhash_near_dup,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_packed_ids": op9_packed_ids,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_classifier": op13_quality_classifier,
}

SQL: dict[str, str] = {"op11_conversation_repair": turns.SQL}
