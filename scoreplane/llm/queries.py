"""Registered queries of the operators: each reads its whole table with the production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreplane.llm import (
    bpe, chat, decontaminate, exact_dedup, langid, mixing, near_dup, pii, quality, ranked, spelling, toxicity, urls,
)
from scoreplane.llm.common import Runner, table

#: Fixed URL rules: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A conversation whose texts look like the template itself.
HOSTILE = r"\### Assistant: </turn> ok"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a fixed rule decides are labelled by it, others by the quality label of their id."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS key", "quality = 0 AS blocked")
    return urls.verdicts(table(spark, sf_dir, "pages"), labels, URL_RULES).withColumnRenamed("key", "page_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.train(docs))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents")).selectExpr(
        "id AS doc_id", "class_id", "n_links", "group_size", "kept")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text")
    hostile = spark.range(2).selectExpr("BIGINT(-7) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role",
                                        "'" + HOSTILE.replace("\\", "\\\\") + "' AS text")
    return chat.read_back(chat.segments(turns.unionByName(hostile)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trips(table(spark, sf_dir, "documents"), bpe.Codec(ranks, public_tokenizers.PATTERN))


REGISTRY: dict[str, Runner] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_chat": op6_chat,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_ranked_search": op12_ranked_search,
    "op13_byte_bpe": op13_byte_bpe,
}
