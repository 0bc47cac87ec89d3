"""Helpers shared by the operators: tables, written intermediates, streamed groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreplane.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only on a local master that names none."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under a new name in the shared folder and read it back.

    Cuts lineage and fixes row ids: a lost executor never makes a later step see other ids.
    Every call takes a path of its own, so nothing stale is read; the files go when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_key(column: str) -> str:
    """SQL for a never-null string key: equal for equal values, nulls share one key of their own."""
    return f"IF(`{column}` IS NULL, 'n', CONCAT('v', CAST(`{column}` AS STRING)))"


def row_key(doc_id: str = "doc_id", text: str = "text") -> str:
    """SQL for a key that only rows equal in id and text share."""
    return f"CONCAT({null_safe_key(doc_id)}, ':', MD5(COALESCE(`{text}`, '')), ':', LENGTH(COALESCE(`{text}`, '')))"


def held_out(doc_id: str, mod: int, remainder: int) -> str:
    """SQL for the held-out flag by crc32 of the id as text; a null id is never held out nor learnt from."""
    return f"COALESCE(CRC32(CAST(`{doc_id}` AS STRING)) % {mod} = {remainder}, FALSE)"


def bounded_sample(rows: DataFrame, kind: str, key: str, most: int, slack: float = 2.0, in_all: int | None = None) -> DataFrame:
    """At most ``most`` rows of every value of ``kind``: the first in the order of a hash of ``key``.

    Where the kinds are so many that these would exceed ``in_all``, each has an equal share of it, one row at least.

    The rows of each kind are counted first; only those whose hash lies in the share that holds about
    ``slack`` times the sample and 32 (so that a small one is full, too) go on to the exact cut, so the work after the count is bounded however many
    rows and partitions there are.  The counts are one row per kind, of which each becomes a part of a model."""
    spark = rows.sparkSession
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return rows.withColumn("_rank", F.lit(1))
    if in_all is not None:
        most = max(1, min(most, in_all // len(counts)))
    told = spark.createDataFrame([(r[0], r[1]) for r in counts], f"`{kind}` {rows.schema[kind].dataType.simpleString()}, `_n` bigint")
    marked = rows.join(F.broadcast(told), kind).withColumn("_u", F.expr(f"PMOD(XXHASH64({key}), 1073741824)"))
    near = marked.where(F.expr(f"_u < {slack * most + 32} / _n * 1073741824"))
    order = Window.partitionBy(kind).orderBy("_u", F.expr(key))
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_n", "_u")


def excerpt(text: str, key: str, chars: int) -> str:
    """SQL for a text of at most ``chars`` characters: the text itself, or a stretch of it placed by the key."""
    return (f"IF(LENGTH({text}) <= {chars}, {text}, SUBSTRING({text},"
            f" 1 + INT(PMOD(XXHASH64({key}), LENGTH({text}) - {chars})), {chars}))")


def batched(frame_rows: Iterator[tuple], columns: Sequence[str], size: int = 4096) -> Iterator[pd.DataFrame]:
    """Gather output tuples into data frames of ``size`` rows."""
    rows: list[tuple] = []
    for row in frame_rows:
        rows.append(row)
        if len(rows) >= size:
            yield pd.DataFrame(rows, columns=list(columns))
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=list(columns))


def pack(docs: DataFrame, **fields: str) -> DataFrame:
    """Select SQL expressions under internal names, so that no column of ``docs`` can clash."""
    return docs.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])


Runner = Callable[[SparkSession, str], DataFrame]
