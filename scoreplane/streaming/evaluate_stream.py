"""Structured Streaming form of the evaluation: new generation records (files
landing in a folder) are parsed, aligned with the static truth table and folded
into running confusion counts.

State is the confusion-count table (one row per distinct run, field, truth and answer), kept by
Spark's state store and restored from the checkpoint after a failure; the truth
join is a stream-static join.  Every metric of ``operators.classify`` derives
from the counts table, so a consumer reads it and calls ``classify.summary``."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scoreplane.operators import classify
from scoreplane.operators.generate import parse_answers
from scoreplane.operators.pairs import FieldSpec, align_pairs
from scoreplane.sources.tables import published, remove

RECORD_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("property_id", T.LongType()), T.StructField("dataset_idx", T.LongType()),
    T.StructField("status_api_call", T.StringType()), T.StructField("latency_s", T.DoubleType()),
    T.StructField("n_images", T.LongType()), T.StructField("raw_answer", T.StringType()),
])


def streaming_counts(spark: SparkSession, records_dir: str, truth: DataFrame, fields: Sequence[FieldSpec],
                     fmt: str = "parquet", schema: T.StructType = RECORD_SCHEMA,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of running confusion counts (A1 over a file stream)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    records = parse_answers(reader.load(records_dir))
    pairs = align_pairs(records, truth, fields)
    return classify.confusion_counts(pairs)


def start_counts_stream(counts: DataFrame, checkpoint_location: str, sink_table: str | None = None,
                        sink_path: str | None = None, trigger_once: bool = False) -> StreamingQuery:
    """Run the count stream in ``complete`` mode into a memory table (tests) or,
    via ``foreachBatch``, into one parquet snapshot of the counts per batch.

    A snapshot is a folder of its own and counts once its write has succeeded, so a reader between two
    batches still sees the last whole one (:func:`latest_snapshot`); only the newest two are kept."""
    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_location)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink_table:
        return w.format("memory").queryName(sink_table).start()

    def snapshot(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch={epoch_id:012d}")
        for old in published(spark, sink_path)[:-2]:
            remove(spark, old)

    return w.foreachBatch(snapshot).start()


def latest_snapshot(spark: SparkSession, sink_path: str) -> DataFrame:
    """The counts as of the last batch that was written whole."""
    return spark.read.parquet(published(spark, sink_path)[-1])
