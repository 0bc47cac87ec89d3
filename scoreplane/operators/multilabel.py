"""Multi-label metrics.

Items carry a set of labels on each side.  The work is one Generate (one row
per item x vocabulary label with three 0/1 flags) and one aggregation keyed by
(by, label) with map-side partial aggregation; the item count never meets a
single task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane.functions.labelsets import label_set, label_set_sql
from scoreplane import constants as K
from scoreplane.functions.sqltext import ident, let, lit


def _ratio(num, den) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def vocab_sql(vocab: Sequence[str]) -> str:
    """The vocabulary as SQL: normalised like the items, de-duplicated and sorted; a constant that is folded once."""
    return label_set_sql("array(" + ", ".join(lit(v) for v in vocab) + ")" if vocab else "CAST(array() AS ARRAY<STRING>)")


def label_flags(items: DataFrame, vocab: Sequence[str], true_col: str = "y_true", pred_col: str = "y_pred",
                by: Sequence[str] = ()) -> DataFrame:
    """(by, label, t, p, tp) per item and vocabulary label; OOV labels are ignored."""
    keys = [ident(b) for b in by]
    sets = items.selectExpr(*keys, f"{label_set_sql(ident(true_col))} AS _t", f"{label_set_sql(ident(pred_col))} AS _p")
    flags = sets.selectExpr(*keys, f"explode(transform({vocab_sql(vocab)}, lab -> named_struct('label', lab, "
                                   "'t', CAST(array_contains(_t, lab) AS BIGINT), "
                                   "'p', CAST(array_contains(_p, lab) AS BIGINT)))) AS f")
    return flags.selectExpr(*keys, "f.label AS label", "f.t AS t", "f.p AS p", "f.t * f.p AS tp")


def per_label(items: DataFrame, vocab: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """(by, label, tp, fp, fn, tn, support_true, support_pred, precision, recall, f1).

    tn = items - tp - fp - fn, so the 2x2 matrix per label is [[tn, fp], [fn, tp]]."""
    f = label_flags(items, vocab, by=by, **kw)
    g = f.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("support_true"), F.sum("p").alias("support_pred"),
        F.count(F.lit(1)).alias("n_items"))
    return g.select(
        *by, "label", "tp",
        (F.col("support_pred") - F.col("tp")).alias("fp"),
        (F.col("support_true") - F.col("tp")).alias("fn"),
        (F.col("n_items") - F.col("support_pred") - F.col("support_true") + F.col("tp")).alias("tn"),
        "support_true", "support_pred",
        _ratio(F.col("tp"), F.col("support_pred")).alias("precision"),
        _ratio(F.col("tp"), F.col("support_true")).alias("recall"),
        _ratio(F.col("tp") * 2, F.col("support_pred") + F.col("support_true")).alias("f1"),
    )


def micro_macro(items: DataFrame, vocab: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Micro and macro P/R/F1 (A11, A12); zero-support labels count as 0 in the macro mean."""
    pl = per_label(items, vocab, by=by, **kw)
    return pl.groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("support_pred")).alias("precision_micro"),
        _ratio(F.sum("tp"), F.sum("support_true")).alias("recall_micro"),
        _ratio(F.sum("tp") * 2, F.sum("support_pred") + F.sum("support_true")).alias("f1_score_micro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_score_macro"),
    )


def subset_accuracy(items: DataFrame, vocab: Sequence[str], true_col: str = "y_true", pred_col: str = "y_pred",
                    by: Sequence[str] = ()) -> DataFrame:
    """Share of items whose in-vocabulary label sets are equal."""
    v = F.expr(vocab_sql(vocab))
    t = F.array_sort(F.array_intersect(label_set(true_col), v))
    p = F.array_sort(F.array_intersect(label_set(pred_col), v))
    return items.groupBy(*by).agg(F.avg((t == p).cast("double")).alias("accuracy_subset"),
                                  F.count(F.lit(1)).alias("n_items"))


def score_row(items: DataFrame, vocab: Sequence[str], true_col: str = "y_true",
              pred_col: str = "y_pred") -> DataFrame:
    """One row with micro, macro and subset scores over a vocabulary of at least one label.  With no items every score is
    1.0 and ``note`` says so (A15).  Two aggregations, no join: the per-item subset
    match rides along on the first vocabulary label."""
    v = vocab_sql(vocab)
    t, p = label_set_sql(ident(true_col)), label_set_sql(ident(pred_col))
    same = f"array_sort(array_intersect(s.t, {v})) = array_sort(array_intersect(s.p, {v}))"
    flags = (f"transform({v}, lab -> named_struct('t', CAST(array_contains(s.t, lab) AS BIGINT), "
             f"'p', CAST(array_contains(s.p, lab) AS BIGINT), 'eq', q))")
    # both label sets are normalised once per item and bound to s
    rows = items.selectExpr(f"posexplode({let(f"named_struct('t', {t}, 'p', {p})", 's', let(f'CAST({same} AS BIGINT)', 'q', flags))}) AS (pos, f)")
    per = rows.groupBy("pos").agg(
        F.sum(F.col("f.t") * F.col("f.p")).alias("tp"), F.sum("f.t").alias("st"), F.sum("f.p").alias("sp"),
        F.sum(F.when(F.col("pos") == 0, F.col("f.eq"))).alias("eq"),
        F.sum(F.when(F.col("pos") == 0, F.lit(1))).alias("n"))
    per = per.select("*", _ratio(F.col("tp"), F.col("sp")).alias("pr"), _ratio(F.col("tp"), F.col("st")).alias("rc"),
                     _ratio(F.col("tp") * 2, F.col("sp") + F.col("st")).alias("f1"))
    g = per.agg(F.sum("tp").alias("tp"), F.sum("sp").alias("sp"), F.sum("st").alias("st"),
                F.avg("pr").alias("pm"), F.avg("rc").alias("rm"), F.avg("f1").alias("fm"),
                F.sum("eq").alias("eq"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))
    empty = F.col("n_items") == 0

    def pick(x):
        return F.when(empty, F.lit(1.0)).otherwise(x)
    return g.select(
        pick(_ratio(F.col("tp"), F.col("sp"))).alias("precision_micro"),
        pick(_ratio(F.col("tp"), F.col("st"))).alias("recall_micro"),
        pick(_ratio(F.col("tp") * 2, F.col("sp") + F.col("st"))).alias("f1_score_micro"),
        pick(F.col("pm")).alias("precision_macro"),
        pick(F.col("rm")).alias("recall_macro"),
        pick(F.col("fm")).alias("f1_score_macro"),
        pick(_ratio(F.col("eq"), F.col("n_items"))).alias("accuracy_subset"),
        F.col("n_items").cast("long").alias("n_items"),
        F.when(empty, F.lit(K.NOTE_NO_LABELS))
        .cast("string").alias("note"),
    )
