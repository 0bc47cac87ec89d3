"""The evaluation plan over the test tables: raw answers -> parsed -> pairs -> metrics.

Each function is lazy; nothing is collected.  One plan covers every run and
every field (the original evaluates one run per process)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreplane.operators import classify, pairs as P
from scoreplane.operators.generate import parse_answers
from scoreplane.plans import adapters as A

RUN = ("model", "temperature")


def dimension(spark: SparkSession) -> DataFrame:
    return P.field_dimension(spark, A.FIELDS)


def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records with their stored parse (map, error text, statuses)."""
    return A.generation_records(spark, sf_dir)


def reparsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with the raw answers parsed again in this plan."""
    return parse_answers(A.generation_records(spark, sf_dir).drop(*A.PARSED_COLUMNS))


def pairs(spark: SparkSession, sf_dir: str, compat: bool = True) -> DataFrame:
    return P.align_pairs(parsed_records(spark, sf_dir), A.truth(spark, sf_dir), A.FIELDS,
                         run_cols=RUN, compat=compat)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.confusion_counts(pairs(spark, sf_dir), RUN)


def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.per_class(counts(spark, sf_dir), dimension(spark), RUN)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.summary(counts(spark, sf_dir), dimension(spark), RUN)
