"""Align predictions with ground truth as long (run, item, field, y_true, y_pred) pairs.

P1 (wide -> long), J1 (prediction-truth join), J3 (field dimension), F1-F4
(skip / failure masks, OOV flag), E2/E13 (canonical labels, member lookup).
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.functions.jsonx import field_value
from scoreplane.functions.sqltext import ident, lit
from scoreplane.functions.text import canonical_label, canonical_sql, normalize_text, slug


# Columns that identify a generation record, when present (used to spread null keys).
RECORD_ID_COLUMNS = ("property_id", "request_id", "record_id")


@dataclass(frozen=True)
class FieldSpec:
    """One categorical field: display name (key in the answer), truth column, vocabulary."""

    name: str
    gt_col: str
    vocab: Sequence[str] = dc_field(default_factory=list)

    def labels(self) -> list[str]:
        """The vocabulary as it appears in canonical labels: normalised, with the placeholders, sorted."""
        return sorted({" ".join(v.lower().split()) for v in self.vocab} | set(K.VOCAB_PLACEHOLDERS))


def field_dimension(spark: SparkSession, fields: Sequence[FieldSpec], dataset: str = "default") -> DataFrame:
    """(dataset, field, field_slug, gt_col, vocab) with the vocabulary normalised,
    extended with the placeholder labels, de-duplicated and sorted (U2, O5).

    The vocabulary is an input keyed by (dataset, field), never a constant (Q9).
    It is a literal of the plan, so its size is known and the planner broadcasts it where it is small."""
    rows = ", ".join(
        f"named_struct('dataset', {lit(dataset)}, 'field', {lit(f.name)}, 'gt_col', {lit(f.gt_col)}, "
        f"'raw_vocab', CAST(array({', '.join(map(lit, f.vocab))}) AS ARRAY<STRING>))" for f in fields)
    # a literal table, so that the planner knows how small it is
    dim = spark.range(1).selectExpr(f"inline(array({rows}))") if fields else spark.range(0).selectExpr(
        "'' AS dataset", "'' AS field", "'' AS gt_col", "CAST(array() AS ARRAY<STRING>) AS raw_vocab")
    placeholders = F.array(*[F.lit(p) for p in K.VOCAB_PLACEHOLDERS])
    vocab = F.array_sort(F.array_distinct(F.concat(
        F.transform("raw_vocab", lambda v: normalize_text(v)), placeholders)))
    return dim.select("dataset", "field", slug(F.col("field")).alias("field_slug"), "gt_col",
                      vocab.alias("vocab"))


def failure_mask_sql(status_col="status_geracao", api_col="status_api_call", parsed_col="parsed") -> str:
    """Directory missing, API failed, or the parsed object is null / empty (F2, Q3)."""
    s, a, p = ident(status_col), ident(api_col), ident(parsed_col)
    return (f"(coalesce({s} = {lit(K.STATUS_DIR_MISSING)}, false) OR coalesce({a} = {lit(K.CALL_FAILED)}, false) "
            f"OR {p} IS NULL OR coalesce(size({p}) = 0, true))")


def failure_mask(status_col="status_geracao", api_col="status_api_call", parsed_col="parsed") -> Column:
    return F.expr(failure_mask_sql(status_col, api_col, parsed_col))


def spread_key(key: str, identity: Sequence[str], extra: str = "") -> str:
    """SQL for the join key (no valid index, value).

    A null or negative index (the invalid-index sentinel) can never match, but all rows with one
    would hash into one partition, and a third of the records may lack an index.  Such rows get a deterministic
    hash of their identity instead: they still match nothing but land in different partitions."""
    k = ident(key)
    told = ", ".join([*[ident(c) for c in identity], *([extra] if extra else [])])
    bad = f"coalesce({k} < 0, true)"
    return f"named_struct('n', {bad}, 'k', CASE WHEN {bad} THEN xxhash64({told}) ELSE CAST({k} AS BIGINT) END)"


def align_pairs(
    predictions: DataFrame,
    truth: DataFrame,
    fields: Sequence[FieldSpec],
    run_cols: Sequence[str] = ("model", "temperature"),
    pred_key: str = "dataset_idx",
    truth_key: str = "item_id",
    parsed_col: str = "parsed",
    compat: bool = True,
) -> DataFrame:
    """Long pairs ``(*run_cols, dataset_idx, field, y_true, y_pred, is_failure, is_skipped)``.

    One left join on the item key (J1; AQE picks broadcast or sort-merge and splits
    skewed partitions), then a single Generate that unpivots the fields of both
    sides at once (P1) - the join input is never multiplied by the field count.

    ``compat=True`` keeps items whose index has no truth row, with the skip label
    on both sides (so they count as correct in accuracy, Q4); ``compat=False``
    drops them (count them with :func:`skipped_counts`)."""
    # canonical truth once per item, canonical prediction once per record - before the join
    t = truth.selectExpr(f"{ident(truth_key)} AS _tkey", "true AS _matched",
                         *[f"{canonical_sql(ident(f.gt_col))} AS _t{i}" for i, f in enumerate(fields)])
    failed = failure_mask_sql(parsed_col=parsed_col)
    fail_label = lit(K.FAILURE_LABEL.lower())
    # rows without a valid index never match: spread them (a hot valid key is left to AQE's skew-join split)
    ids = [c for c in RECORD_ID_COLUMNS if c in predictions.columns]
    key = ident(pred_key)
    p = predictions.selectExpr(
        *[ident(c) for c in run_cols], key, f"{failed} AS is_failure",
        f"{spread_key(pred_key, [*run_cols, *ids], f'map_entries({ident(parsed_col)})')} AS _jk",
        *[f"CASE WHEN {failed} THEN {fail_label} ELSE "
          f"{canonical_sql(f'try_element_at({ident(parsed_col)}, {lit(f.name)})')} END AS _p{i}"
          for i, f in enumerate(fields)])
    t = t.withColumn("_tk", F.struct(F.lit(False).alias("n"), F.col("_tkey").cast("bigint").alias("k")))
    joined = p.join(t, p["_jk"] == t["_tk"], "left")

    skip_label = lit(K.SKIPPED_LABEL.lower())
    entries = ", ".join(
        f"named_struct('field', {lit(f.name)}, "
        f"'y_true', CASE WHEN _matched IS NULL THEN {skip_label} ELSE _t{i} END, "
        f"'y_pred', CASE WHEN _matched IS NULL THEN {skip_label} ELSE _p{i} END)"
        for i, f in enumerate(fields))
    out = joined.selectExpr(*[ident(c) for c in run_cols], ident(pred_key), "is_failure",
                            "_matched IS NULL AS is_skipped", f"explode(array({entries})) AS _e")
    out = out.select(*run_cols, pred_key, "_e.field", "_e.y_true", "_e.y_pred", "is_failure", "is_skipped")
    if not compat:
        out = out.filter(~F.col("is_skipped"))
    return out


def skipped_counts(predictions: DataFrame, truth: DataFrame, run_cols=("model", "temperature"),
                   pred_key: str = "dataset_idx", truth_key: str = "item_id") -> DataFrame:
    """Items per run whose index has no truth row (F1): left-anti join, then count.

    Rows without a valid index are spread over the join as in :func:`align_pairs`."""
    ids = [c for c in RECORD_ID_COLUMNS if c in predictions.columns]
    p = predictions.selectExpr(*[ident(c) for c in run_cols], f"{spread_key(pred_key, [*run_cols, *ids])} AS _jk")
    t = truth.selectExpr(f"named_struct('n', false, 'k', CAST({ident(truth_key)} AS BIGINT)) AS _jk")
    return p.join(t, "_jk", "left_anti").groupBy(*run_cols).agg(F.count(F.lit(1)).alias("n_skipped"))


def with_vocab_flags(pairs: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``true_in_vocab`` / ``pred_in_vocab`` (F4) to pairs or their counts via the dimension."""
    d = dim.select("field", "vocab")
    return (pairs.join(d, "field", "left")
            .withColumn("true_in_vocab", F.coalesce(F.array_contains("vocab", F.col("y_true")), F.lit(False)))
            .withColumn("pred_in_vocab", F.coalesce(F.array_contains("vocab", F.col("y_pred")), F.lit(False)))
            .drop("vocab"))


def unpivot_truth(truth: DataFrame, fields: Sequence[FieldSpec], key: str = "item_id") -> DataFrame:
    """Wide truth -> (key, field, y_true raw) (P1), column names mapped to field names."""
    renamed = truth.select(key, *[F.col(f.gt_col).cast("string").alias(f.name) for f in fields])
    return renamed.unpivot([key], [f.name for f in fields], "field", "y_true")
