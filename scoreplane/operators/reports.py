"""Evaluation documents and report tables.

Report tables hold one row per (run, category); windows over them partition by
model, a bounded group."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.functions.text import (
    escape_special, evaluation_file_name, first_present, fixed, model_from_file_name, safe_model_name, settled, slug,
    temperature_from_file_name,
)

METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_score_weighted"]
RUN = ("model", "temperature")


def shown_model(model: Column) -> Column:
    return F.translate(model, ":", "_")


def category_report(summ: DataFrame) -> DataFrame:
    """(Modelo, Temperatura, category_key, Categoria, metrics) straight from a summary (P2, J7): what the
    documents would give back, without building them.  Error rows are skipped."""
    valid = summ.filter(F.col("error").isNull())
    return valid.select(
        shown_model(F.col("model")).alias("Modelo"), F.col("temperature").cast("string").alias("Temperatura"),
        slug(F.col("field")).alias("category_key"), F.col("field").alias("Categoria"),
        F.col("accuracy").alias("Accuracy"), F.col("f1_score_weighted").alias("F1-Score"),
        F.col("precision_weighted").alias("Precision"), F.col("recall_weighted").alias("Recall"))


def averages_report(macro: DataFrame, meta: DataFrame | None = None, by: Sequence[str] = RUN,
                    latency_col: str = "latencia_total_resposta_modelo_s") -> DataFrame:
    """One averages row per run with its run time (P3), straight from the macro averages."""
    joined = macro if meta is None else macro.join(meta, list(by), "left")
    return joined.select(
        shown_model(F.col("model")).alias("Modelo"), F.col("temperature").cast("string").alias("Temperatura"),
        F.col("accuracy").alias("Accuracy"), F.col("f1_score_weighted").alias("F1-Score"),
        F.col("precision_weighted").alias("Precision"), F.col("recall_weighted").alias("Recall"),
        *([] if meta is None else [F.col(latency_col).alias("Tempo de Execucao Total (s)")]))


def evaluation_documents(summ: DataFrame, meta: DataFrame | None = None, by: Sequence[str] = RUN) -> DataFrame:
    """One document per run (K2): its file name and its JSON text in the layout that the report job reads:
    ``metadata_avaliacao``, then one block per category and one of averages keyed by ``<metric>_<safe model>``.

    ``summ`` carries the per-class map (``summary_from_labels(..., with_classes=True)``).  ``meta`` adds any of
    ``timestamp_avaliacao``, ``arquivo_resultados_gerados_avaliado``, ``dataset_ground_truth_usado`` and
    ``latencia_total_resposta_modelo_s`` per run.  Collects are per run and bounded by the number of fields."""
    safe = safe_model_name(F.col("model"))
    block = F.when(F.col("error").isNull(), F.to_json(F.struct(
        *[F.col(m) for m in METRICS], F.col("labels_used_for_metrics"), F.col("metrics_per_class")))).otherwise(
        F.to_json(F.struct("error")))
    valid = F.col("error").isNull() & F.col("accuracy").isNotNull()
    docs = summ.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(slug(F.col("field")).alias("k"), block.alias("v")))).alias("blocks"),
        *[F.avg(F.when(valid, F.col(m))).alias(f"avg_{m}") for m in METRICS],
        F.count_if(valid).alias("n_valid"), F.max("n_items").alias("total_itens_avaliados"))
    if meta is not None:
        docs = docs.join(meta, list(by), "left")
    told = {c: F.col(c) if c in docs.columns else F.lit(None) for c in (
        "timestamp_avaliacao", "arquivo_resultados_gerados_avaliado", "dataset_ground_truth_usado",
        "latencia_total_resposta_modelo_s")}
    head = F.to_json(F.struct(
        told["timestamp_avaliacao"].cast("string").alias("timestamp_avaliacao"),
        told["arquivo_resultados_gerados_avaliado"].cast("string").alias("arquivo_resultados_gerados_avaliado"),
        told["dataset_ground_truth_usado"].cast("string").alias("dataset_ground_truth_usado"),
        F.col("model").alias("modelo_avaliado"), F.col("temperature").alias("temperatura"),
        told["latencia_total_resposta_modelo_s"].cast("double").alias("latencia_total_resposta_modelo_s"),
        "total_itens_avaliados", F.col("n_valid").alias("total_categorias_com_media_calculada")))
    names = [*METRICS, "num_categories_in"]
    averages = F.when(F.col("n_valid") > 0, F.to_json(F.map_from_arrays(
        F.array(*[F.concat(F.lit(f"{n}_"), safe) for n in names]),
        F.array(*[F.col(f"avg_{m}") for m in METRICS], F.col("n_valid").cast("double"))))).otherwise(
        F.to_json(F.struct(F.lit(K.ERR_NO_CATEGORIES).alias("error"))))
    entries = F.array_append("blocks", F.struct(F.concat(F.lit(K.AVERAGES_KEY_PREFIX), safe).alias("k"), averages.alias("v")))

    def key(x: Column) -> Column:  # the key as a JSON string
        text = F.to_json(F.create_map(x, F.lit(0)))
        return F.substr(text, F.lit(2), F.length(text) - 4)
    body = F.array_join(F.transform(entries, lambda e: F.concat(key(e["k"]), F.lit(": "), e["v"])), ", ")
    return docs.select(*by, evaluation_file_name(F.col("model"), F.col("temperature")).alias("file_name"), F.concat(
        F.lit('{"metadata_avaliacao": '), head, F.lit(', "Metricas_Agregadas_Por_Categoria": {'), body, F.lit("}}")).alias("document"))


def run_identity(docs: DataFrame) -> DataFrame:
    """Adds Modelo and Temperatura to documents read back: metadata, else the file name, else the constants."""
    m = F.col("metadata_avaliacao")
    name_temp = F.regexp_replace(temperature_from_file_name("file_name"), r"_\d{8}_\d{6}$", "")
    return docs.withColumns({
        "Modelo": shown_model(first_present(F.nullif(m["modelo_avaliado"], F.lit("")), model_from_file_name("file_name"),
                                            F.lit(K.UNKNOWN_MODEL))),
        "Temperatura": first_present(m["temperatura"].cast("string"), name_temp, F.lit(K.TEMPERATURE_UNKNOWN))})


def flatten_categories(docs: DataFrame, field_names: DataFrame | None = None) -> DataFrame:
    """(Modelo, Temperatura, category_key, Categoria, metrics) from documents read back.

    Error blocks are skipped; the averages block was split off by the reader by its prefix, so models
    with '/' keep their row (Q14 fixed)."""
    e = run_identity(docs).select("Modelo", "Temperatura", F.explode("Metricas_Agregadas_Por_Categoria").alias("category_key", "v"))
    e = e.filter(F.col("v.error").isNull())
    cat = F.col("category_key")
    if field_names is not None:
        names = field_names.select(slug(F.col("field")).alias("category_key"), F.col("field").alias("_display"))
        e = e.join(names, "category_key", "left")
        cat = F.coalesce("_display", "category_key")
    return e.select("Modelo", "Temperatura", "category_key", cat.alias("Categoria"),
                    F.col("v.accuracy").alias("Accuracy"), F.col("v.f1_score_weighted").alias("F1-Score"),
                    F.col("v.precision_weighted").alias("Precision"), F.col("v.recall_weighted").alias("Recall"))


def overall_rows(docs: DataFrame) -> DataFrame:
    """One averages row per document read back, with the run time (P3); a document without averages has none."""
    d = run_identity(docs).filter(F.col("averages").isNotNull() & (F.size("averages") > 0))

    def get(metric: str) -> Column:  # the keys end in the model's name, whatever its spelling
        found = F.filter(F.map_entries("averages"), lambda e: F.startswith(e["key"], F.lit(metric + "_")))
        return F.try_element_at(found, F.lit(1))["value"]
    return d.select("Modelo", "Temperatura", get("accuracy").alias("Accuracy"), get("f1_score_weighted").alias("F1-Score"),
                    get("precision_weighted").alias("Precision"), get("recall_weighted").alias("Recall"),
                    F.col("metadata_avaliacao.latencia_total_resposta_modelo_s").alias("Tempo de Execucao Total (s)"))


def metrics_long(report: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns -> (ids, metric, value), nulls dropped."""
    return report.unpivot(list(ids), list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def report_columns(with_metrics: bool = True, with_temperature: bool = True, with_time: bool = False) -> list[str]:
    """Column family switches."""
    cols = ["Modelo"]
    if with_temperature:
        cols.append("Temperatura")
    if with_metrics:
        cols += ["Accuracy", "F1-Score", "Precision", "Recall"]
    if with_time:
        cols.append("Tempo de Execucao Total (s)")
    return cols


def display_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename columns for display (P9); names that are absent are ignored."""
    names = K.DISPLAY_NAMES if names is None else names
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def numeric_temperature(col: str = "Temperatura") -> Column:
    return F.col(col).try_cast("double")


def sorted_report(report: DataFrame, keys: Sequence[str] = ("Modelo", "Categoria")) -> DataFrame:
    """Sort by keys, then numeric temperature, nulls last (O1, O2)."""
    return report.orderBy(*[F.col(k).asc_nulls_last() for k in keys], numeric_temperature().asc_nulls_last(),
                          F.col("Temperatura").asc_nulls_last())


def report_rows(report: DataFrame, metric_cols: Sequence[str], group_col: str = "Modelo",
                sub_col: str | None = "Categoria", temp_col: str | None = "Temperatura",
                places: int = 2) -> DataFrame:
    """Table rows with grouped-cell suppression (W1, W2), span counts (A16), a rule
    before each new group but the first (W4), escaped text (E9) and fixed numbers (E8).

    Windows stay inside a group; the order of the lines is the sink's matter."""
    order = [F.col(group_col)] + ([F.col(sub_col)] if sub_col else []) + \
        ([numeric_temperature(temp_col).asc_nulls_last(), F.col(temp_col)] if temp_col else [])
    w_g = Window.partitionBy(group_col).orderBy(*order[1:] or [F.lit(1)])
    cells = []
    rn_g = F.row_number().over(w_g)
    n_g = F.count(F.lit(1)).over(Window.partitionBy(group_col))
    g_text = F.format_string(K.GROUP_CELL, n_g, escape_special(group_col, True))
    cells.append(F.when(rn_g == 1, g_text).otherwise(F.lit("")))
    out_cols = [F.col(group_col), (rn_g == 1).alias("show_group"), n_g.alias("group_rows")]
    if sub_col:
        w_s = Window.partitionBy(group_col, sub_col).orderBy(*order[2:] or [F.lit(1)])
        rn_s = F.row_number().over(w_s)
        n_s = F.count(F.lit(1)).over(Window.partitionBy(group_col, sub_col))
        s_text = F.format_string(K.SUBGROUP_CELL, n_s, escape_special(sub_col))
        cells.append(F.when(rn_s == 1, s_text).otherwise(F.lit("")))
        out_cols += [F.col(sub_col), (rn_s == 1).alias("show_sub"), n_s.alias("sub_rows")]
    if temp_col:
        t = numeric_temperature(temp_col)
        cells.append(F.when(t.isNotNull(), fixed(t, places)).otherwise(escape_special(temp_col)))
        out_cols.append(F.col(temp_col))
    for m in metric_cols:
        cells.append(F.coalesce(fixed(settled(F.col(f"`{m}`")), places), F.lit(K.NO_NUMBER)))
    # a rule stands before the first row of every group but the first one in the order
    rule = (rn_g == 1) & (F.col(group_col) != report.agg(F.min(group_col)).scalar())
    text = F.concat(F.lit("    "), F.concat_ws(" & ", *cells), F.lit(" \\\\"))
    return report.select(*out_cols, rule.alias("rule_before"), text.alias("row_text"))


def best_per_group(report: DataFrame, group_col: str, metric: str, tie_cols: Sequence[str]) -> DataFrame:
    """One row per group with the highest metric; ties to the smallest tie columns.

    ``max(struct(metric, -tie...))`` is a partially aggregated max - no window sort."""
    best = report.groupBy(group_col).agg(F.max(F.struct(
        F.col(f"`{metric}`").alias("m"),
        *[(-F.col(c).try_cast("double")).alias(f"neg_{i}") for i, c in enumerate(tie_cols)],
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(tie_cols)])).alias("b"))
    return best.select(group_col, *[F.col(f"b.k_{i}").alias(c) for i, c in enumerate(tie_cols)],
                       F.col("b.m").alias(metric))


def latest_per_key(docs: DataFrame, keys: Sequence[str], stamp_col: str, tie_cols: Sequence[str] = ()) -> DataFrame:
    """Latest document per key (W5) via ``max_by`` - aggregated, no window.

    Equal stamps go by ``tie_cols`` (largest first), then by a hash of the whole row, so the answer does
    not depend on the order of the input."""
    others = [c for c in docs.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    order = F.struct(F.col(stamp_col).alias("s"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_cols)],
                     F.xxhash64(F.to_json(packed)).alias("h"))
    return docs.groupBy(*keys).agg(F.max_by(packed, order).alias("d")).select(*keys, "d.*")


def unify_generators(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append records of both generator schemas; twin columns coalesced."""
    u = a.unionByName(b, allowMissingColumns=True)
    lat = [c for c in ("latencia_total_api_s", "latencia_api_s") if c in u.columns]
    return u.withColumn("latency_s", F.coalesce(*[F.col(c) for c in lat]))


def latency_stats(records: DataFrame, by: Sequence[str] = RUN, col: str = "latency_s") -> DataFrame:
    """Per-run latency sums and moments (A17); all distributive, skew-safe."""
    return records.groupBy(*by).agg(
        F.count(col).alias("n_timed"), F.sum(col).alias("total_s"), F.avg(col).alias("mean_s"),
        F.min(col).alias("min_s"), F.max(col).alias("max_s"))


def latency_quantiles(records: DataFrame, by: Sequence[str] = RUN, col: str = "latency_s",
                      accuracy: int = 10000) -> DataFrame:
    """Approximate p50 / p90 / p99 (bounded-memory sketches, fine for a hot run)."""
    return records.groupBy(*by).agg(
        F.percentile_approx(col, [0.5, 0.9, 0.99], accuracy).alias("q"))


def latency_sketch(records: DataFrame, by: Sequence[str] = RUN, col: str = "latency_s", error: float = 0.01) -> DataFrame:
    """Mergeable quantile sketch (A17): counts of values per logarithmic bucket, (by, bucket, n).

    Bucket i holds the values in (g^(i-1), g^i] with g = (1 + error) / (1 - error), so every value in it is within the relative
    ``error`` of the bucket's middle: the bound holds for every quantile and input.  Its size grows with the logarithm of the
    range of the values, not with their number.  Values of 0 or less are in bucket null and count as 0."""
    width = F.log(F.lit((1 + error) / (1 - error)))
    timed = records.filter(F.col(col).isNotNull())
    bucket = F.when(F.col(col) > 0, F.ceil(F.log(F.col(col)) / width).cast("long"))
    return timed.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts added up into those of the whole: the same as the sketch of all values."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, quantiles: Sequence[float], by: Sequence[str] = RUN, error: float = 0.01) -> DataFrame:
    """(by, quantile, n, value): the value of rank ceil(quantile * n) within the relative ``error``."""
    g = (1 + error) / (1 - error)
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketches.select(*by, "bucket", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(whole).alias("n"))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    reached = ranked.select(*by, "bucket", "_upto", "n", asked).filter(F.col("_upto") >= F.ceil(F.col("quantile") * F.col("n")))
    first = reached.groupBy(*by, "quantile").agg(F.min_by("bucket", "_upto").alias("_b"), F.min("n").alias("n"))
    return first.select(*by, "quantile", "n", F.coalesce(
        F.pow(F.lit(g), F.col("_b").cast("double")) * F.lit(2 / (g + 1)), F.lit(0.0)).alias("value"))
