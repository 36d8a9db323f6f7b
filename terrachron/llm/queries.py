"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_conversations(rows.unionByName(probe)))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gif import payload_gifs

    return payload_gifs(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_chat_format, op3_gif, op4_toxicity, op5_bpe,
        op6_token_counts, op7_decontamination, op8_token_files, op9_minhash, op10_substring,
    )
}

ORACLES: dict[str, str] = {}
