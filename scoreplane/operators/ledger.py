"""Resumable generation (I1, I2): a ledger of stored answers, so a restarted job never repeats an answered call.

Every call has an identity: the digest of its keys and of the whole request (model, prompts, options, images).  The calls
asked for are anti-joined with the ledger; what is left is dealt into small tasks, and a task's answers join the
ledger when it ends, not when the job does.  A job that dies loses the answers of the tasks that were running and no others: at most
``calls_per_task`` calls a task slot.  The next job, with the same grid or a larger one, calls what is missing."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreplane.operators.generate import ANSWER_FIELDS, REQUEST, Generator, batch_generate
from scoreplane.sources.tables import has_files

CALL_ID = "call_id"
CALLS_PER_TASK = 32


def identified(requests: DataFrame) -> DataFrame:
    """``requests`` with the identity of every call."""
    told = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(requests.columns)]), {"ignoreNullFields": "false"})
    return requests.withColumn(CALL_ID, F.sha2(told, 256))


def _schema(requests: DataFrame) -> T.StructType:
    keys = [f for f in requests.schema if f.name != REQUEST]
    return T.StructType([*keys, T.StructField(CALL_ID, T.StringType()), *ANSWER_FIELDS, T.StructField("job", T.StringType())])


def answers(requests: DataFrame, path: str) -> DataFrame:
    """The stored answers of the given requests, with their keys and the name of the job that called; calls without an answer
    have none."""
    spark, schema = requests.sparkSession, _schema(requests)
    if not has_files(spark, path):
        return spark.createDataFrame([], schema)
    kept = spark.read.schema(schema).parquet(path)
    # a task that was tried twice may have stored a call twice
    return kept.join(identified(requests).select(CALL_ID).distinct(), CALL_ID, "left_semi").dropDuplicates([CALL_ID])


def resume(requests: DataFrame, generate: Generator, path: str, job: str = "", retry_failed: bool = False,
           calls_per_task: int = CALLS_PER_TASK, batch_rows: int = 1) -> DataFrame:
    """Call the model for every request that the ledger under ``path`` has no answer to, store the answers there, and return
    those of all requests.  A failed call is an answer too, unless ``retry_failed``.  Requests that are equal in keys and content
    are one call.  One job uses a ledger at a time."""
    spark, schema = requests.sparkSession, _schema(requests)
    asked = identified(requests).dropDuplicates([CALL_ID])
    if has_files(spark, path):
        known = spark.read.schema(schema).parquet(path)
        if retry_failed:
            known = known.where("error_message IS NULL")
        asked = asked.join(known.select(CALL_ID), CALL_ID, "left_anti")
    left = asked.count()
    if left:
        made = batch_generate(asked, generate, -(-left // calls_per_task), batch_rows).withColumn("job", F.lit(job))
        # version 2 of the committer puts a task's file in place when the task ends
        made.select(*schema.names).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    found = answers(requests, path) if not retry_failed else _latest(requests, path)
    return found


def _latest(requests: DataFrame, path: str) -> DataFrame:
    """As :func:`answers`; of several answers to a call, one without an error."""
    schema = _schema(requests)
    kept = requests.sparkSession.read.schema(schema).parquet(path).join(
        identified(requests).select(CALL_ID).distinct(), CALL_ID, "left_semi")
    # a map cannot be compared, so the row is chosen by its error alone
    best = kept.groupBy(CALL_ID).agg(F.min_by(F.struct(*[c for c in schema.names if c != CALL_ID]),
                                              F.when(F.col("error_message").isNull(), 0).otherwise(1)).alias("a"))
    return best.select(CALL_ID, "a.*").select(*schema.names)


def failed_calls(stored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Answered and failed calls a group (a report of the ledger)."""
    return stored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.count("error_message").alias("n_failed"))
