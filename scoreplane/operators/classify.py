"""Single-label classification metrics over long pairs.

Everything derives from one aggregation, the confusion counts (A1).  That is the
only shuffle that sees raw pairs; map-side partial aggregation shrinks each task
to its distinct (run, field, truth, answer) combinations, so a run, field or label holding a
third of all pairs costs nothing extra.  Answers are open text, so this table is bounded by the
distinct answers; the label table after it folds answers outside the vocabulary into one bucket.

Two label universes (Q5): accuracy uses every pair, precision / recall / F1 and
supports only labels of the field vocabulary; empty denominators give 0.0 (Q6).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.functions.sqltext import ident, lit
from scoreplane.operators.pairs import FieldSpec

RUN = ("model", "temperature")


def confusion_counts(pairs: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """(by, field, y_true, y_pred, n) (A1)."""
    return pairs.groupBy(*by, "field", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _keys_as_text(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Floating-point keys as text: grouping normalises such keys anew in every step, so no step would
    recognise the partitioning of the one before."""
    return df.withColumns({b: F.col(b).cast("string") for b in by if df.schema[b].dataType.typeName() in ("double", "float")})


def _keys_typed(df: DataFrame, by: Sequence[str], like: DataFrame) -> DataFrame:
    return df.withColumns({b: F.col(b).cast(like.schema[b].dataType) for b in by if df.schema[b].dataType != like.schema[b].dataType})


def label_table(counts: DataFrame, dim: DataFrame, by: Sequence[str] = RUN, expected: DataFrame | None = None) -> DataFrame:
    """Per (by, field, label): truth support, predicted support, true positives and vocabulary membership
    (see :func:`_label_table`)."""
    return _keys_typed(_label_table(counts, dim, by, expected), by, counts)


def _label_table(counts: DataFrame, dim: DataFrame, by: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """Per (by, field, label): truth support, predicted support, true positives and
    vocabulary membership, zero-filled for every vocabulary label (A3, J5).

    A field without a vocabulary (absent from the dimension, or an empty list) is scored over its
    observed labels (A6).  Open-text answers outside the vocabulary fold into one bucket
    (label null), so the table holds at most the vocabulary and one row more per (by, field), however many
    different answers there are.  The vocabulary's zero rows are made once per (by, field), not once per count row.  ``expected`` lists the (by, field) that must appear even without a pair (F9).

    No side is forced to be broadcast: the dimension is the caller's, and the runtime sizes decide."""
    placeholders = ", ".join(map(lit, K.VOCAB_PLACEHOLDERS))
    closed = dim.filter(f"size(array_except(vocab, array({placeholders}))) > 0").select("field", "vocab")
    known = closed.selectExpr("field", "explode(vocab) AS label", "true AS in_vocab")
    listed = closed.selectExpr("field", "true AS closed")
    keys = [ident(b) for b in by]
    counts = _keys_as_text(counts, by)
    expected = None if expected is None else _keys_as_text(expected, by)
    sides = counts.selectExpr(*keys, "field", "inline(array(named_struct('label', y_true, 't', n, "
                              "'tp', CASE WHEN y_true = y_pred THEN n ELSE 0L END, 'p', 0L), "
                              "named_struct('label', y_pred, 't', 0L, 'tp', 0L, 'p', n)))")
    told = sides.join(known, ["field", "label"], "left").join(listed, "field", "left").selectExpr(
        *keys, "field", "CASE WHEN in_vocab OR closed IS NULL THEN label END AS label", "t", "tp", "p")
    g = told.groupBy(*by, "field", "label").agg(F.sum("t").alias("t"), F.sum("tp").alias("tp"), F.sum("p").alias("p"))
    if expected is not None:
        g = g.unionByName(expected.selectExpr(*keys, "field", "CAST(NULL AS STRING) AS label", "0L AS t", "0L AS tp", "0L AS p"))
    # the first row of each (by, field) brings the zero rows; what follows keeps this partitioning
    first = F.row_number().over(Window.partitionBy(*by, "field").orderBy("label")) == 1
    row = "named_struct('label', label, 't', t, 'tp', tp, 'p', p)"
    zero = "transform(coalesce(vocab, array()), v -> named_struct('label', v, 't', 0L, 'tp', 0L, 'p', 0L))"
    g = g.withColumn("_first", first).join(closed, "field", "left").selectExpr(
        *keys, "field", f"inline(CASE WHEN _first THEN concat(array({row}), {zero}) ELSE array({row}) END)")
    g = g.groupBy(*by, "field", "label").agg(
        F.sum("t").alias("support_true"), F.sum("tp").alias("tp"), F.sum("p").alias("support_pred"))
    return _class_scores(g.withColumn("in_vocab", F.col("label").isNotNull()))


def ratio_sql(num: str, den: str) -> str:
    """num / den as double, 0.0 when den is 0 or null (zero_division=0); never throws under ANSI."""
    return f"coalesce(try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE)), 0.0D)"


def _class_scores(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "*",
        f"{ratio_sql('tp', 'support_pred')} AS precision",
        f"{ratio_sql('tp', 'support_true')} AS recall",
        f"{ratio_sql('tp * 2', 'support_pred + support_true')} AS f1",
    )


def per_class(counts: DataFrame, dim: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """(by, field, label, precision, recall, f1, support_true, support_pred, tp) for every
    vocabulary label, zero-filled (A3, A4, J5, Q8)."""
    return label_table(counts, dim, by).filter("in_vocab").drop("in_vocab")


CLASS_ENTRY = ("struct(label AS key, named_struct('precision', precision, 'recall', recall, 'f1-score', f1, "
               "'support_ground_truth', support_true, 'support_predicted', support_pred) AS value)")


def summary_from_labels(lt: DataFrame, by: Sequence[str] = RUN, with_classes: bool = False) -> DataFrame:
    """Summary from a label table; an expected group without pairs carries an ``error`` text
    instead of raising or vanishing (F9).  Length mismatches cannot arise once pairs are rows.

    ``with_classes`` adds the per-class map (P6) in the same aggregation, bounded by the vocabulary."""
    w = "CASE WHEN in_vocab THEN support_true ELSE 0 END"
    classes = [
        F.expr("array_sort(collect_list(CASE WHEN in_vocab THEN label END))").alias("labels_used_for_metrics"),
        F.expr(f"map_from_entries(array_sort(collect_list(CASE WHEN in_vocab THEN {CLASS_ENTRY} END)))").alias("metrics_per_class"),
    ] if with_classes else []
    agg = lt.groupBy(*by, "field").agg(
        F.expr(f"{ratio_sql('sum(tp)', 'sum(support_true)')}").alias("accuracy"),
        F.expr(f"{ratio_sql(f'sum(precision * {w})', f'sum({w})')}").alias("precision_weighted"),
        F.expr(f"{ratio_sql(f'sum(recall * {w})', f'sum({w})')}").alias("recall_weighted"),
        F.expr(f"{ratio_sql(f'sum(f1 * {w})', f'sum({w})')}").alias("f1_score_weighted"),
        F.expr("sum(support_true)").alias("n_items"),
        F.expr("sum(CASE WHEN NOT in_vocab THEN support_pred ELSE 0 END)").alias("n_oov_pred"),
        *classes,
    )
    return agg.selectExpr("*", f"CAST(CASE WHEN n_items = 0 THEN {lit(K.ERR_NO_PAIRS)} END AS STRING) AS error")


def summary(counts: DataFrame, dim: DataFrame, by: Sequence[str] = RUN, expected: DataFrame | None = None,
            with_classes: bool = False) -> DataFrame:
    """(by, field, accuracy, precision_weighted, recall_weighted, f1_score_weighted,
    n_items, n_oov_pred, error) (A2, A5, A7).

    Weighted = truth-support-weighted mean over the vocabulary; accuracy over all
    pairs; both from the same small label table in one aggregation."""
    return _keys_typed(summary_from_labels(_label_table(counts, dim, by, expected), by, with_classes), by, counts)


def evaluate(pairs: DataFrame, dim: DataFrame, by: Sequence[str] = RUN):
    """Whole evaluator for all runs and fields in one plan: (counts, per_class, summary)."""
    counts = confusion_counts(pairs, by)
    lt = label_table(counts, dim, by)
    return counts, lt.filter("in_vocab").drop("in_vocab"), summary_from_labels(lt, by)


def macro_average(summ: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Unweighted mean over valid categories + their count (A9, F5, Q10, Q11 fixed)."""
    valid = summ.filter(F.col("error").isNull() & F.col("accuracy").isNotNull())
    return valid.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy"),
        F.avg(F.coalesce("f1_score_weighted", F.lit(0.0))).alias("f1_score_weighted"),
        F.avg(F.coalesce("precision_weighted", F.lit(0.0))).alias("precision_weighted"),
        F.avg(F.coalesce("recall_weighted", F.lit(0.0))).alias("recall_weighted"),
        F.count(F.lit(1)).alias("n_categories"),
    )


def summary_with_overall(summ: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Per-category rows plus one overall row per run, in one GROUPING SETS pass (A10)."""
    valid = summ.filter(F.col("error").isNull() & F.col("accuracy").isNotNull())
    metrics = ["accuracy", "f1_score_weighted", "precision_weighted", "recall_weighted"]
    g = valid.groupingSets([[*by, "field"], list(by)], *by, "field").agg(
        *[F.avg(m).alias(m) for m in metrics], F.grouping("field").alias("is_overall"))
    return g.select(
        *by,
        F.when(F.col("is_overall") == 1, F.lit(K.OVERALL_CATEGORY)).otherwise(F.col("field")).alias("category"),
        *metrics,
        (F.col("is_overall") == 1).alias("is_overall"),
    )


def confusion_matrix(pairs: DataFrame, spec: FieldSpec, by: Sequence[str] = RUN) -> DataFrame:
    """Dense matrix for one field: a row per vocabulary truth label, a column per
    vocabulary predicted label (P5), both from the field's own vocabulary.  Pairs with an
    out-of-vocabulary side are dropped (Q18); the pivot gets its value list up front, so no extra job and a
    fixed schema, and the field is filtered before anything is counted."""
    labels = spec.labels()
    mine = pairs.filter(F.col("field") == spec.name)
    cells = mine.groupBy(*by, "y_true").pivot("y_pred", labels).agg(F.count(F.lit(1)))
    rows = mine.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(v) for v in labels])).alias("y_true"))
    out = rows.join(cells, [*by, "y_true"], "left")
    return out.select(*by, F.lit(spec.name).alias("field"), "y_true",
                      *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("long")).alias(v) for v in labels])


def per_class_map(pc: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """(by, field, labels_used_for_metrics, metrics_per_class MAP).

    The collect is per (run, field) and bounded by the vocabulary size."""
    entry = F.struct(
        F.col("label").alias("key"),
        F.struct(F.col("precision"), F.col("recall"), F.col("f1").alias("f1-score"),
                 F.col("support_true").alias("support_ground_truth"),
                 F.col("support_pred").alias("support_predicted")).alias("value"))
    return pc.groupBy(*by, "field").agg(
        F.array_sort(F.collect_list("label")).alias("labels_used_for_metrics"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics_per_class"))


def observed_labels(pairs_or_counts: DataFrame) -> DataFrame:
    """Label domain seen in the data, truth and prediction sides."""
    t = pairs_or_counts.select("field", F.col("y_true").alias("label"))
    p = pairs_or_counts.select("field", F.col("y_pred").alias("label"))
    return t.union(p).distinct()
