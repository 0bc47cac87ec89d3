"""Sinks (K1-K5).  Everything is written by executors in parallel; nothing passes
through the driver.  Reports are written beside their place and put there by a rename."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreplane import constants as K
from scoreplane.functions.text import fixed, settled
from scoreplane.operators.reports import flatten_categories, overall_rows
from scoreplane.sources.files import read_committed_runs, read_evaluation_documents
from scoreplane.sources.tables import files_in, has_files, move, publish, remove, write_once


def spread_by_run(items: DataFrame, run_cols: Sequence[str], key_cols: Sequence[str],
                  files_per_run: int) -> DataFrame:
    """One shuffle on (run, hash(key) mod k) before a partitioned write: each run
    directory gets about ``files_per_run`` files instead of one per writing task,
    and a run holding a third of the rows is still written by k tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(files_per_run))
    return items.repartition(*[F.col(c) for c in run_cols], salt)


def write_generation_items(items: DataFrame, path: str, run_cols: Sequence[str] = ("model", "temperature"),
                           fmt: str = "parquet", key_cols: Sequence[str] = ("dataset_idx", "property_id"),
                           files_per_run: int | None = None) -> None:
    """K1: generation items partitioned by run (one directory per model/temperature).

    The run document of the original tool holds every item in one JSON value;
    at scale that is one unbounded record, so items are written as rows and the
    run metadata separately (:func:`write_run_metadata`).  A run written again replaces its own folder; others stay."""
    if files_per_run:
        keys = [c for c in key_cols if c in items.columns]
        items = spread_by_run(items, run_cols, keys, files_per_run)
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run_cols).format(fmt).save(path)


def write_run_metadata(items: DataFrame, path: str, started: datetime, finished: datetime,
                       run_cols: Sequence[str] = ("model", "temperature"), status_col: str = "status_geracao",
                       attempt: str | None = None) -> None:
    """K1 metadata: per run its counts, start and end stamps and the elapsed seconds between them.

    Calls run in parallel, so the elapsed time is told by the job that made them and not summed from latencies.
    Each run has a folder of its own, replaced when the run is written again."""
    meta = items.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("total_itens_na_saida_run"),
        F.count_if(F.col(status_col) == K.STATUS_OK).alias("n_success")).withColumns({
            "timestamp_geracao_inicial_run": F.lit(started.isoformat()),
            "timestamp_geracao_final_run": F.lit(finished.isoformat()),
            "timestamp_final_run": F.lit((finished - started).total_seconds())})
    if attempt is not None:
        meta = meta.withColumn("attempt", F.lit(attempt))
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run_cols).json(path)


def write_generation_run(items: DataFrame, path: str, run_cols: Sequence[str] = ("model", "temperature"),
                         files_per_run: int | None = None) -> DataFrame:
    """K1: run the generation once, store its items and their metadata, and return the stored items.

    The model is called while the items are written and never again.  The items go to a folder of this attempt inside their run's;
    a run is committed when its metadata name the attempt.  A run written again replaces its former self at that moment,
    other runs stay, and an attempt that failed is never read (:func:`~scoreplane.sources.files.read_committed_runs`)."""
    spark, attempt, started = items.sparkSession, uuid.uuid4().hex, datetime.now(timezone.utc)
    marked = items.withColumn("attempt", F.lit(attempt))
    if files_per_run:
        keys = [c for c in ("request_id", "dataset_idx", "property_id") if c in items.columns]
        marked = spread_by_run(marked, run_cols, keys, files_per_run)
    marked.write.mode("append").partitionBy(*run_cols, "attempt").parquet(f"{path}/items")
    stored = spark.read.schema(marked.schema).parquet(f"{path}/items").where(F.col("attempt") == attempt).drop("attempt")
    write_run_metadata(stored, f"{path}/metadata", started, datetime.now(timezone.utc), run_cols, attempt=attempt)
    return stored


def drop_replaced_attempts(spark: SparkSession, path: str, schema: T.StructType,
                           run_cols: Sequence[str] = ("model", "temperature")) -> int:
    """Remove the folders of attempts that no run's metadata name; returns their number.  Not while a run is written."""
    from scoreplane.sources.tables import folders

    committed = read_committed_runs(spark, path, schema, run_cols)
    kept = {unquote(r[0]).split("/items/")[1] for r in committed.select(
        F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct().collect()}  # one per run
    old = [f for f in folders(spark, f"{path}/items/{'*/' * len(run_cols)}attempt=*") if f.split("/items/")[1] not in kept]
    for folder in old:
        remove(spark, folder)
    return len(old)


def _write_named(rows: DataFrame, path: str) -> None:
    """One text file per ``file_name`` out of its lines (file_name, text), which lie in order within their partition.

    Executors write every file into a folder of its own; the driver only renames the files, one per run."""
    spark = rows.sparkSession
    attempt = f"{path.rstrip('/')}/_attempt-{uuid.uuid4().hex}"
    rows.select("file_name", "text").write.partitionBy("file_name").text(attempt)
    for folder, file in files_in(spark, attempt):
        move(spark, file, f"{path.rstrip('/')}/{unquote(folder.removeprefix('file_name='))}")
    remove(spark, attempt)


def _claimed_names(docs: DataFrame, path: str, run_cols: Sequence[str]) -> DataFrame:
    """(run, name): the file of every run.  A run keeps the name the manifest gives it; a name that several
    runs of this write want, or that another run owns, gets a digest of the run."""
    spark, manifest = docs.sparkSession, f"{path.rstrip('/')}/.manifest"
    wanted = docs.select("run", "file_name").distinct()
    known = spark.read.schema("run string, name string").json(manifest) if has_files(spark, manifest) else (
        spark.createDataFrame([], "run string, name string"))
    new = wanted.join(known, "run", "left_anti")
    rivals = new.groupBy("file_name").agg(F.count(F.lit(1)).alias("rivals"))
    owned = known.select(F.col("name").alias("file_name"), F.lit(True).alias("owned")).distinct()
    own = F.regexp_replace("file_name", F.lit(r"(_temp_[^/]*)?\.json$"), F.concat(F.lit("-"), F.substring("run", 1, 12), F.lit("$1.json")))
    made = write_once(new.join(rivals, "file_name").join(owned, "file_name", "left").select(
        "run", F.when((F.col("rivals") > 1) | F.col("owned"), own).otherwise(F.col("file_name")).alias("name")), "names")
    made.coalesce(1).write.mode("append").json(manifest)  # one row per run; claimed before any file is written
    return known.join(wanted, "run", "left_semi").unionByName(made)


def write_evaluation_documents(docs: DataFrame, path: str, run_cols: Sequence[str] = ("model", "temperature")) -> None:
    """K2: one named JSON file per run (file_name, document), as the report scan (S4) finds them.

    File names fold signs, so different runs may want one name: ``.manifest`` in the folder says which run owns which file,
    and every run keeps a file of its own.  A run written again replaces its file.  One job writes to a folder at a time."""
    known = [F.col(c) for c in run_cols if c in docs.columns] or [F.col("file_name")]
    kept = write_once(docs.select(F.sha2(F.to_json(F.struct(*known), {"ignoreNullFields": "false"}), 256).alias("run"),
                                  "file_name", "document"), "evaluation-documents")
    names = write_once(_claimed_names(kept, path, run_cols), "document-names")
    _write_named(kept.join(names, "run").select(F.col("name").alias("file_name"), F.col("document").alias("text"))
                 .repartition("file_name"), path)


def write_run_documents(items: DataFrame, metadata: DataFrame, path: str, order_col: str) -> None:
    """K1 in the form of nested run documents: one indented JSON file per ``file_name``.

    ``items`` has file_name, ``order_col`` and the struct ``item``; ``metadata`` has file_name and the struct ``meta``.  The items
    of a document are streamed in order through one task and never held together."""
    place = Window.partitionBy("file_name").orderBy(order_col)
    told = items.join(metadata, "file_name").select(
        "file_name", F.to_json("item").alias("item"), F.to_json("meta").alias("meta"),
        (F.row_number().over(place) == 1).alias("first"), F.lead(F.lit(1)).over(place).isNull().alias("last"))
    head = F.concat(F.lit('{\n  "metadata_geracao_run": '), F.col("meta"), F.lit(',\n  "resultados_gerados_run": [\n'))
    inner = F.substring(F.col("item"), F.lit(2), F.length("item") - 2)
    _write_named(told.select("file_name", F.concat(
        F.when(F.col("first"), head).otherwise(F.lit("")), F.lit("    {\n      "), inner, F.lit("\n    }"),
        F.when(F.col("last"), F.lit("\n  ]\n}")).otherwise(F.lit(","))).alias("text")), path)


def write_summary_csv(summary: DataFrame, path: str, metric_cols: Sequence[str], places: int = 4,
                      partition_cols: Sequence[str] = (), order_cols: Sequence[str] = ()) -> None:
    """K3: per-run summary CSV with fixed decimals, header, one directory per run; rows in the given order.

    A run's rows are one per field, so each run is ordered inside one task."""
    cols = [c for c in summary.columns if c not in metric_cols and c not in set(order_cols) - set(partition_cols) - {"category"}]
    rows = summary
    if partition_cols:
        rows = rows.repartition(*[F.col(f"`{c}`") for c in partition_cols])
    if order_cols or partition_cols:
        rows = rows.sortWithinPartitions(*[F.col(f"`{c}`") for c in [*partition_cols, *order_cols]])
    out = rows.select(*[F.col(f"`{c}`") for c in cols],
                      *[fixed(settled(F.col(f"`{m}`")), places).alias(m) for m in metric_cols])
    attempt = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    w = out.write.option("header", True)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.csv(attempt)
    publish(summary.sparkSession, attempt, path)


def write_report_csv(report: DataFrame, path: str, columns: Sequence[str], number_cols: Sequence[str],
                     places: int = 4) -> bool:
    """K4: fixed column order (existing columns only), 4 decimals, rows in report order; no file when empty.

    The rows are counted while they are written; the plan runs once."""
    keep = [c for c in columns if c in report.columns]
    seen = Observation()
    text = [F.col(f"`{c}`").asc_nulls_last() for c in keep if c not in number_cols]
    ordered = report.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*text) if text else report.observe(
        seen, F.count(F.lit(1)).alias("n"))
    out = ordered.select(*[fixed(settled(F.col(f"`{c}`")), places).alias(c) if c in number_cols else F.col(f"`{c}`")
                           for c in keep])
    attempt = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    out.write.option("header", True).csv(attempt)
    if seen.get["n"]:
        publish(report.sparkSession, attempt, path)
        return True
    remove(report.sparkSession, attempt)
    remove(report.sparkSession, path)
    return False


def write_text_rows(rows: DataFrame, path: str, order_cols: Sequence[str], text_col: str = "row_text",
                    rule_col: str | None = "rule_before") -> None:
    """K5: report rows as text lines in report order (range-partitioned sort), with a rule line before each new
    group where the rows tell one."""
    lines = F.array(F.col(text_col))
    if rule_col and rule_col in rows.columns:
        lines = F.when(F.col(rule_col), F.array(F.lit(K.RULE_LINE), F.col(text_col))).otherwise(lines)
    out = rows.select(*[F.col(c) for c in order_cols], F.posexplode(lines).alias("_line", "_text"))
    out.orderBy(*order_cols, "_line").select("_text").write.mode("overwrite").text(path)


def write_reports(spark: SparkSession, root: str, out_dir: str, field_names: DataFrame | None = None) -> tuple[bool, bool]:
    """Scan every evaluation document under ``root`` and write both report files (S4 -> E6 -> P2, P3 -> K4).

    Returns whether the by-category and the overall report have rows."""
    docs = read_evaluation_documents(spark, root)
    metrics = ["Accuracy", "F1-Score", "Precision", "Recall"]
    by_category = write_report_csv(flatten_categories(docs, field_names), f"{out_dir}/report_metrics_by_category",
                                   K.REPORT_BY_CATEGORY_COLUMNS, metrics)
    overall = write_report_csv(overall_rows(docs), f"{out_dir}/report_overall_model_averages", K.REPORT_OVERALL_COLUMNS,
                               [*metrics, "Tempo de Execucao Total (s)"])
    return by_category, overall
