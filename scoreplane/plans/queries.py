"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the shared tables (or data Spark derives from them) in full.
Floating results are rounded to 6 places so value hashes are stable across
engines and partitionings."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.operators import classify
from scoreplane.operators import pairs as P
from scoreplane.plans import adapters as A
from scoreplane.plans import evaluation as E

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
RUN = ["model", "temperature"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------ classification
@query
def confusion_counts(spark, sf):
    return E.counts(spark, sf)


@query
def field_accuracy(spark, sf):
    s = E.summary(spark, sf)
    return s.select(*RUN, "field", r6("accuracy").alias("accuracy"), "n_items")


@query
def per_class_metrics(spark, sf):
    pc = E.per_class(spark, sf)
    return pc.select(*RUN, "field", "label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1").alias("f1"), "support_true", "support_pred", "tp")


@query
def weighted_metrics(spark, sf):
    s = E.summary(spark, sf)
    return s.select(*RUN, "field", r6("accuracy").alias("accuracy"),
                    r6("precision_weighted").alias("precision_weighted"),
                    r6("recall_weighted").alias("recall_weighted"),
                    r6("f1_score_weighted").alias("f1_score_weighted"), "n_items", "n_oov_pred")


@query
def macro_average(spark, sf):
    m = classify.macro_average(E.summary(spark, sf), RUN)
    return m.select(*RUN, *[r6(c).alias(c) for c in
                            ["accuracy", "f1_score_weighted", "precision_weighted", "recall_weighted"]],
                    "n_categories")


@query
def summary_with_overall(spark, sf):
    s = classify.summary_with_overall(E.summary(spark, sf), RUN)
    return s.select(*RUN, "category", *[r6(c).alias(c) for c in
                                        ["accuracy", "f1_score_weighted", "precision_weighted", "recall_weighted"]],
                    "is_overall")


@query
def confusion_matrix_pivot(spark, sf):
    return classify.confusion_matrix(E.pairs(spark, sf), A.FIELDS[0], RUN)


@query
def per_class_map(spark, sf):
    m = classify.per_class_map(E.per_class(spark, sf), RUN)
    rows = m.select(*RUN, "field", F.array_join("labels_used_for_metrics", "|").alias("labels_used"),
                    F.size("metrics_per_class").alias("n_labels"), F.explode("metrics_per_class").alias("label", "m"))
    return rows.select(*RUN, "field", "labels_used", "n_labels", "label", *[
        r6(F.col("m").getField(name)).alias(name.replace("-", "_")) for name in ("precision", "recall", "f1-score")],
        *[F.col("m").getField(f"support_{side}").cast("long").alias(f"support_{side}") for side in ("ground_truth", "predicted")])


@query
def observed_labels(spark, sf):
    return classify.observed_labels(E.counts(spark, sf))


@query
def vocab_with_placeholders(spark, sf):
    """Vocabulary (normalised + placeholders, sorted) with its observed truth support."""
    dim = E.dimension(spark).select("field", F.posexplode("vocab").alias("position", "label"))
    c = E.counts(spark, sf).groupBy("field", F.col("y_true").alias("label")).agg(F.sum("n").alias("support_true"))
    return dim.join(c, ["field", "label"], "left").select(
        "field", "label", F.col("position").cast("int").alias("position"),
        F.coalesce("support_true", F.lit(0).cast("long")).alias("support_true"))


@query
def oov_rate(spark, sf):
    """From the confusion counts: one vocabulary test per distinct answer, not per pair."""
    c = P.with_vocab_flags(E.counts(spark, sf), E.dimension(spark))
    out = F.sum(F.when(~F.col("pred_in_vocab"), F.col("n")).otherwise(0))
    return c.groupBy(*RUN, "field").agg(out.alias("n_oov"), r6(out / F.sum("n")).alias("oov_rate"))


@query
def no_vocab_metrics(spark, sf):
    """Fields without a vocabulary are scored over their observed labels."""
    dim = P.field_dimension(spark, [P.FieldSpec(f.name, f.gt_col) for f in A.FIELDS])
    s = classify.summary(E.counts(spark, sf), dim, RUN)
    return s.select(*RUN, "field", r6("accuracy").alias("accuracy"), r6("precision_weighted").alias("precision_weighted"),
                    r6("recall_weighted").alias("recall_weighted"), r6("f1_score_weighted").alias("f1_score_weighted"), "error")


@query
def empty_field(spark, sf):
    """A field that is expected and has no pair gives an error row in every run."""
    extra = [*A.FIELDS, P.FieldSpec("Unseen", "gt_unseen", ["a", "b"])]
    counts = E.counts(spark, sf)
    expected = counts.select(*RUN).distinct().select(*RUN, F.explode(F.array(*[F.lit(f.name) for f in extra])).alias("field"))
    s = classify.summary(counts, P.field_dimension(spark, extra), RUN, expected)
    return s.select(*RUN, "field", "n_items", "error")


@query
def oov_values(spark, sf):
    """Out-of-vocabulary predictions (left anti join against the exploded vocabulary)."""
    vocab = E.dimension(spark).select("field", F.explode("vocab").alias("y_pred"))
    c = E.counts(spark, sf).join(vocab, ["field", "y_pred"], "left_anti")
    return c.groupBy("field", "y_pred").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------ masks and statuses
@query
def failure_masked_pairs(spark, sf):
    p = E.pairs(spark, sf).filter("is_failure AND NOT is_skipped")
    return p.select(*RUN, "dataset_idx", "field", "y_true", "y_pred")


@query
def skipped_items(spark, sf):
    return P.skipped_counts(A.generation_records(spark, sf), A.truth(spark, sf), RUN)


@query
def status_breakdown(spark, sf):
    """Status, image and parse counts per run (A8), parsing the raw answers in this plan."""
    r = E.reparsed_records(spark, sf)
    return r.groupBy(*RUN, "status_geracao").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_images").alias("n_images"),
        F.count_if(F.col("status_json_parsing") == K.CALL_OK).alias("n_parsed"))


@query
def unpivot_fields(spark, sf):
    return P.unpivot_truth(A.truth(spark, sf), A.FIELDS)


# ------------------------------------------------------------ text expressions
from scoreplane.functions import jsonx as JX  # noqa: E402
from scoreplane.functions import media as MD  # noqa: E402
from scoreplane.functions import text as TX  # noqa: E402
from scoreplane.functions import timefmt as TF  # noqa: E402
from scoreplane.functions.vectors import argmax, class_scores  # noqa: E402
from scoreplane.operators import grid as G  # noqa: E402
from scoreplane.operators import multilabel as ML  # noqa: E402
from scoreplane.operators import reports as R  # noqa: E402
from scoreplane.operators import similarity as SIM  # noqa: E402
from scoreplane.sources.tables import read_table  # noqa: E402


def _runs(spark, sf):
    return A.generation_records(spark, sf).select(*RUN).distinct()


@query
def canonical_labels(spark, sf):
    """Distinct raw predicted values per field and their canonical label."""
    r = E.parsed_records(spark, sf).filter(F.col("parsed").isNotNull())
    raw = r.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"),
                                                JX.field_value("parsed", f.name).alias("raw_value"))
                                       for f in A.FIELDS])).alias("e")).select("e.*")
    return raw.distinct().select("field", "raw_value", TX.canonical_label("raw_value").alias("label"))


@query
def normalized_text(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", TX.normalize_text("text").alias("text_norm"))


@query
def slugs(spark, sf):
    p = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", TX.slug(F.concat_ws(" ", "p_type", "p_name")).alias("slug"))


@query
def safe_names(spark, sf):
    r = _runs(spark, sf)
    return r.select(*RUN, TX.safe_model_name("model").alias("model_safe"),
                    TX.safe_temperature("temperature").alias("temp_safe"),
                    TX.evaluation_file_name(F.col("model"), F.col("temperature")).alias("file_name"))


def _file_names(spark, sf):
    r = _runs(spark, sf)
    plain = TX.evaluation_file_name(F.col("model"), F.col("temperature"))
    stamped = F.regexp_replace(plain, r"\.json$", "_20250619_130001.json")
    return r.select(*RUN, F.explode(F.array(plain, stamped)).alias("file_name"))


@query
def filename_parse(spark, sf):
    f = _file_names(spark, sf)
    return f.select("file_name", TX.model_from_file_name("file_name").alias("model_from_name"),
                    F.regexp_replace(TX.temperature_from_file_name("file_name"), r"_\d{8}_\d{6}$", "")
                    .alias("temperature_from_name"))


@query
def metadata_fallback(spark, sf):
    """Model: metadata, else file name, else constant; run time: final (unless 0), else total."""
    rec = A.generation_records(spark, sf)
    runs = rec.groupBy(*RUN).agg(F.sum("latency_s").alias("total_s"))
    meta_model = F.when(F.col("temperature") != 0.5, F.col("model"))
    name_model = F.when(F.col("temperature") != 1.0, TX.model_from_file_name(
        TX.evaluation_file_name(F.col("model"), F.col("temperature"))))
    final_s = F.when(F.col("temperature") == 0.0, F.lit(0.0)).otherwise(F.col("total_s") + 1)
    return runs.select(*RUN, TX.first_present(meta_model, name_model, F.lit(K.UNKNOWN_MODEL)).alias("model_resolved"),
                       r6(TX.nonzero_or(final_s, F.col("total_s"))).alias("run_time_s"))


@query
def coerce_temperature(spark, sf):
    r = _runs(spark, sf)
    label = F.when(F.col("temperature") == 1.0, F.lit(K.TEMPERATURE_UNKNOWN)).otherwise(
        F.col("temperature").cast("string"))
    return r.select(*RUN, label.alias("label"), TX.to_number(label).alias("temperature_num"))


@query
def fixed_format(spark, sf):
    s = E.summary(spark, sf)
    return s.select(*RUN, "field", TX.fixed(TX.settled("accuracy"), 2).alias("accuracy_2"),
                    TX.fixed(TX.settled("f1_score_weighted"), 4).alias("f1_4"),
                    TX.fixed(TX.settled(F.col("n_items") / 8), 2).alias("eighths_2"))


@query
def escaped_labels(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", TX.escape_special("url").alias("escaped"),
                    TX.escape_special(F.concat(F.lit("~^{}\\_$"), F.col("url")), True).alias("escaped_model"))


# ------------------------------------------------------------ JSON in free text
@query
def json_candidate(spark, sf):
    r = A.generation_records(spark, sf)
    return r.select(*RUN, "property_id", JX.json_candidate("raw_answer").alias("candidate"))


@query
def json_clean(spark, sf):
    r = A.generation_records(spark, sf)
    return r.select(*RUN, "property_id", JX.clean_json(JX.json_candidate("raw_answer")).alias("cleaned"))


@query
def json_strict_parse(spark, sf):
    raw = A.generation_records(spark, sf).drop(*A.PARSED_COLUMNS)
    r = JX.with_extracted_json(raw, "raw_answer", "parsed", "err")
    kind = (F.when(F.col("err").isNull(), F.lit("ok"))
            .when(F.col("err") == K.ERR_EMPTY_RESPONSE, F.lit("empty"))
            .when(F.col("err") == K.ERR_NO_JSON, F.lit("no_json")).otherwise(F.lit("invalid")))
    return r.select(*RUN, "property_id", kind.alias("outcome"), F.size("parsed").alias("n_members"))


@query
def json_fields(spark, sf):
    ev = JX.with_extracted_json(read_table(spark, sf, "events").select("event_id", "props"), "props")
    return ev.select("event_id", JX.field_value("parsed", "k").alias("k"),
                     JX.field_value("parsed", "k").try_cast("double").alias("k_num"))


# ------------------------------------------------------------ time
@query
def latency_stats(spark, sf):
    s = R.latency_stats(A.generation_records(spark, sf))
    return s.select(*RUN, "n_timed", r6("total_s").alias("total_s"), r6("mean_s").alias("mean_s"),
                    r6("min_s").alias("min_s"), r6("max_s").alias("max_s"))


@query
def api_seconds(spark, sf):
    """Nanosecond durations as API reports give them, in seconds."""
    rec = A.generation_records(spark, sf).filter("latency_s IS NOT NULL")
    ns = F.round(F.col("latency_s") * 1000).cast("long") * 1_000_000
    return rec.select(*RUN, "property_id", r6(TF.nanos_to_seconds(ns)).alias("seconds"))


@query
def iso_stamps(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "ts")
    g = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("user_id", TF.iso_utc("first_ts").alias("first_iso"), TF.run_stamp("last_ts").alias("last_stamp"),
                    r6(TF.elapsed_seconds("first_ts", "last_ts")).alias("active_s"))


# ------------------------------------------------------------ media / paths
@query
def base64_data_url(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return p.select("page_id", MD.mime_type("url").alias("mime"),
                    MD.data_url(F.encode("html", "UTF-8"), "url").alias("data_url"))


@query
def suspicious_paths(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url", "html")
    cands = p.select("page_id", F.explode(F.array(
        F.struct(F.lit("url").alias("kind"), F.col("url").alias("value")),
        F.struct(F.lit("data_url").alias("kind"), MD.data_url(F.encode("html", "UTF-8"), "url").alias("value")),
        F.struct(F.lit("base64").alias("kind"), MD.to_base64(F.encode("html", "UTF-8")).alias("value")),
    )).alias("c")).select("page_id", "c.kind", "c.value")
    return cands.select("page_id", "kind", MD.looks_like_base64("value").alias("suspicious"))


@query
def path_basename(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", MD.basename("url").alias("basename"), MD.extension("url").alias("extension"),
                    MD.is_image_name("url").alias("is_image"))


# ------------------------------------------------------------ multi-label (events)
def _multilabel_items(spark, sf):
    """T4: per (user, day) the set of event types; prediction = the user's previous active day.

    collect_set is bounded by the event-type vocabulary; the lag window holds one
    row per active day of a user."""
    from pyspark.sql import Window
    ev = read_table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    days = ev.groupBy("user_id", "day").agg(F.collect_set("event_type").alias("y_true"))
    w = Window.partitionBy("user_id").orderBy("day")
    return days.select("user_id", "day", "y_true",
                       F.coalesce(F.lag("y_true").over(w), F.array().cast("array<string>")).alias("y_pred"))


def _hot(c):
    from scoreplane.functions.labelsets import multi_hot
    v = F.array(*[F.lit(x) for x in A.MULTILABEL_VOCAB])
    return F.array_join(F.transform(multi_hot(c, v), lambda x: x.cast("string")), "")


@query
def label_lists(spark, sf):
    """Comma lists as normalised label sets."""
    from scoreplane.functions.labelsets import label_set, split_list
    p = read_table(spark, sf, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(" , ")).alias("items"))
    return p.select("p_partkey", F.array_join(label_set(split_list("items")), "|").alias("labels"))


@query
def multihot(spark, sf):
    it = _multilabel_items(spark, sf)
    return it.select("user_id", "day", _hot("y_true").alias("true_hot"), _hot("y_pred").alias("pred_hot"))


@query
def multilabel_micro(spark, sf):
    s = ML.score_row(_multilabel_items(spark, sf), A.MULTILABEL_VOCAB)
    return s.select(*[r6(c).alias(c) for c in ["precision_micro", "recall_micro", "f1_score_micro"]], "n_items")


@query
def multilabel_macro(spark, sf):
    s = ML.score_row(_multilabel_items(spark, sf), A.MULTILABEL_VOCAB)
    return s.select(*[r6(c).alias(c) for c in ["precision_macro", "recall_macro", "f1_score_macro"]])


@query
def subset_accuracy(spark, sf):
    s = ML.subset_accuracy(_multilabel_items(spark, sf), A.MULTILABEL_VOCAB)
    return s.select(r6("accuracy_subset").alias("accuracy_subset"), "n_items")


@query
def label_2x2(spark, sf):
    pl = ML.per_label(_multilabel_items(spark, sf), A.MULTILABEL_VOCAB)
    return pl.select("label", "tn", "fp", "fn", "tp", r6("precision").alias("precision"),
                     r6("recall").alias("recall"), r6("f1").alias("f1"))


@query
def multilabel_empty(spark, sf):
    """The score row of no items (A15): every score 1.0 and a note."""
    none = read_table(spark, sf, "events").filter("event_type = 'no such type'").select(
        F.array("event_type").alias("y_true"), F.array("event_type").alias("y_pred"))
    return ML.score_row(none, A.MULTILABEL_VOCAB)


@query
def multilabel_by_user_activity(spark, sf):
    """Scores per activity band of the user (number of active days), one group per band."""
    it = _multilabel_items(spark, sf)
    from pyspark.sql import Window
    band = F.when(F.count(F.lit(1)).over(Window.partitionBy("user_id")) >= 25, F.lit("high")).otherwise(F.lit("low"))
    it = it.withColumn("band", band)
    mm = ML.micro_macro(it, A.MULTILABEL_VOCAB, by=["band"])
    return mm.select("band", *[r6(c).alias(c) for c in ["precision_micro", "recall_micro", "f1_score_micro",
                                                         "precision_macro", "recall_macro", "f1_score_macro"]])


# ------------------------------------------------------------ vectors
def _letter_counts():
    """A stand-in encoder: length and counts of three letters."""
    import numpy as np
    return lambda texts: np.array([[len(t), t.count("a"), t.count("e"), t.count("n")] for t in texts], float)


@query
def text_similarity(spark, sf):
    """Cosine of every user turn and the turn after it, through an injected encoder."""
    t = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    e = SIM.embed_texts(t, "text", _letter_counts)
    a = e.filter("role = 'user'").select("conv_id", "turn", F.col("embedding").alias("left_vec"))
    b = e.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("embedding").alias("right_vec"))
    return SIM.cosine_pairs(a.join(b, ["conv_id", "turn"])).select("conv_id", "turn", r6("cosine").alias("cosine"))


@query
def cosine_pairs(spark, sf):
    v = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    c = SIM.cosine_pairs(SIM.neighbour_pairs(v))
    return c.select("left_id", "right_id", r6("cosine").alias("cosine"))


VECTOR_FIELDS = [P.FieldSpec("class", "label", [str(i) for i in range(10)]), P.FieldSpec("half", "label", ["low", "high"])]


@query
def vector_class_metrics(spark, sf):
    """Truth = label, prediction = the class with the largest sum over the whole vector; scored as
    the class itself and as its half by the same evaluator as the categorical fields."""
    v = read_table(spark, sf, "embeddings").select("label", argmax(class_scores("embedding", 10)).alias("c"))

    def half(c):
        return F.when(F.col(c) < 5, F.lit("low")).otherwise(F.lit("high"))

    def entry(name, true, pred):
        return F.struct(F.lit(name).alias("field"), true.alias("y_true"), pred.alias("y_pred"))
    prs = v.select(F.lit("class-sums").alias("model"), F.explode(F.array(
        entry("class", F.col("label").cast("string"), F.col("c").cast("string")),
        entry("half", half("label"), half("c")))).alias("e")).select("model", "e.*")
    s = classify.summary(classify.confusion_counts(prs, ["model"]), P.field_dimension(spark, VECTOR_FIELDS), ["model"])
    return s.select("model", "field", r6("accuracy").alias("accuracy"),
                    r6("precision_weighted").alias("precision_weighted"),
                    r6("recall_weighted").alias("recall_weighted"),
                    r6("f1_score_weighted").alias("f1_score_weighted"), "n_items")


# ------------------------------------------------------------ grid, matching, requests
REQUESTED_MODELS = [*A.MODELS, "delta-vl:70b", "  "]


@query
def experiment_grid(spark, sf):
    items = A.truth(spark, sf).select("item_id")
    g = G.experiment_grid(items, A.MODELS, A.TEMPERATURES)
    return g.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("min_item"),
                               F.max("item_id").alias("max_item"))


@query
def available_models(spark, sf):
    rec = A.generation_records(spark, sf).filter(F.col("status_api_call") == K.CALL_OK)
    return G.model_availability(spark, REQUESTED_MODELS, rec.select(F.col("model").alias("name")))


def _directories(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    cid = F.col("c_custkey").cast("string")
    tag = F.lower(F.translate("c_name", "#", "_"))
    return c.select(F.explode(F.array(
        F.when(F.col("c_custkey") % 3 == 0, cid),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(cid, F.lit("_"), tag)),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(cid, F.lit("_b"))),
        F.when(F.col("c_custkey") % 7 == 0, F.concat(cid, F.lit("1_x"))),
    )).alias("dir_name")).filter(F.col("dir_name").isNotNull())


@query
def entity_directory_match(spark, sf):
    ent = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return G.match_directories(ent, _directories(spark, sf))


@query
def request_assembly(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return G.assemble_prompts(turns)


# ------------------------------------------------------------ generation with a stub model
def stub_generate(req: dict) -> dict:
    """Deterministic stand-in for a model endpoint: answers with counts of its prompt."""
    prompt = req.get("prompt") or ""
    if not prompt:
        return {"error": "empty prompt"}
    images = req.get("images")
    body = '{"n_chars": %d, "n_images": %d}' % (len(prompt), 0 if images is None else len(images))
    resp = "Result:\n```json\n" + body + "\n```"
    return {"response": resp, "latency_s": 0.0,
            "usage": {"prompt_chars": len(prompt), "response_chars": len(resp)}}


def _prompts(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return G.assemble_prompts(turns).withColumnRenamed("conv_id", "request_id")


def _work(spark, sf):
    """(items, directories, files): one entity per conversation, its images from the page of the same number."""
    items = _prompts(spark, sf).select("request_id", F.col("request_id").cast("string").alias("entity_id"), "system", "prompt")
    name = F.when(F.col("request_id") % 2 == 0, F.col("entity_id")).otherwise(F.concat("entity_id", F.lit("_home")))
    dirs = items.filter("request_id % 7 <> 3").select("request_id", name.alias("dir_name"))
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("request_id"), "url", "html")
    listing = dirs.join(pages, "request_id").select("request_id", "dir_name", F.explode(F.array(
        F.struct(F.lit("notes.txt").alias("name"), F.encode("url", "UTF-8").alias("content")),
        F.when(F.col("request_id") % 5 != 4, F.struct(F.lit("front.png").alias("name"), F.encode("url", "UTF-8").alias("content"))),
        F.when((F.col("request_id") % 5 != 4) & (F.col("request_id") % 3 == 0),
               F.struct(F.lit("Back.JPG").alias("name"), F.encode("html", "UTF-8").alias("content"))))).alias("f"))
    files = listing.filter("f IS NOT NULL").select(
        F.concat(F.lit("/data/"), "dir_name", F.lit("/"), "f.name").alias("path"), "f.content")
    return items, dirs.select("dir_name"), files


CALL_TASKS = 16


@query
def batch_generate(spark, sf):
    from scoreplane.operators.generate import batch_generate as call
    requests = G.experiment_grid(_prompts(spark, sf), A.MODELS, A.TEMPERATURES).select(
        "request_id", *RUN, G.request_struct(F.col("model"), F.col("temperature"), F.col("system"), F.col("prompt"))
        .alias("request"))
    out = A.cached_generation("batch", requests, stub_generate, lambda r, g: call(r, g, CALL_TASKS))
    return out.select("request_id", *RUN, "status_api_call", "raw_answer")


def _grid_output(spark, sf):
    from scoreplane.operators.generate import run_grid
    items, dirs, files = _work(spark, sf)
    return A.cached_generation("grid", items, stub_generate, lambda r, g: run_grid(
        r, A.MODELS, A.TEMPERATURES, g, CALL_TASKS, dirs, files))


@query
def grid_generation(spark, sf):
    """Grid x items -> directories -> images -> model calls -> strict parse -> status."""
    return _grid_output(spark, sf).select(
        "request_id", *RUN, "status_geracao", JX.field_value("parsed", "n_chars").try_cast("long").alias("n_chars"),
        "n_images", JX.field_value("parsed", "n_images").try_cast("long").alias("n_images_seen"), "error_message")


@query
def usage_totals(spark, sf):
    from scoreplane.operators.generate import usage_totals as ut
    return ut(_grid_output(spark, sf), by=["model"])


# ------------------------------------------------------------ pre-flight and first-n
@query
def first_n(spark, sf):
    """First 10 items by key (O3): the limit is the feature."""
    return A.truth(spark, sf).orderBy("item_id").limit(10)


@query
def first_valid(spark, sf):
    """Per run, the first item whose answer parsed (O4) - an aggregated min, no sort; records without a valid index are spread."""
    r = E.parsed_records(spark, sf).filter(F.col("status_geracao") == K.STATUS_OK)
    r = r.withColumn("_key", F.expr(P.spread_key("dataset_idx", [*RUN, "property_id"])))
    r = r.join(A.truth(spark, sf).select(F.expr("named_struct('n', false, 'k', item_id)").alias("_key")), "_key", "left_semi")
    return r.groupBy(*RUN).agg(F.min("dataset_idx").alias("first_valid_idx"))


@query
def preflight_checks(spark, sf):
    """First 5 items: directory found, images found, one item processed (I4)."""
    from scoreplane.operators.generate import preflight
    items, dirs, files = _work(spark, sf)
    return preflight(items, 5, stub_generate, dirs, files, A.MODELS[0])


# ------------------------------------------------------------ reports
def _meta(spark, sf):
    return A.generation_records(spark, sf).groupBy(*RUN).agg(
        F.sum("latency_s").alias("latencia_total_resposta_modelo_s"))


def _field_names(spark):
    return E.dimension(spark).select("field")


def _report(spark, sf):
    return R.category_report(E.summary(spark, sf))


def _overall(spark, sf):
    return R.averages_report(classify.macro_average(E.summary(spark, sf), RUN), _meta(spark, sf))


REPORT_METRICS = ["Accuracy", "F1-Score", "Precision", "Recall"]


@query
def flatten_reports(spark, sf):
    rep = _report(spark, sf)
    return rep.select("Modelo", "Temperatura", "Categoria", *[r6(F.col(f"`{m}`")).alias(m) for m in REPORT_METRICS])


@query
def display_category(spark, sf):
    return _report(spark, sf).select("category_key", "Categoria").distinct()


@query
def overall_rows(spark, sf):
    o = _overall(spark, sf)
    return o.select("Modelo", "Temperatura", *[r6(F.col(f"`{m}`")).alias(m) for m in REPORT_METRICS],
                    r6(F.col("`Tempo de Execucao Total (s)`")).alias("Tempo de Execucao Total (s)"))


@query
def metrics_long(spark, sf):
    rep = _report(spark, sf)
    lg = R.metrics_long(rep, ["Modelo", "Temperatura", "Categoria"], REPORT_METRICS)
    return lg.select("Modelo", "Temperatura", "Categoria", "metric", r6("value").alias("value"))


@query
def report_rows(spark, sf):
    rows = R.report_rows(_report(spark, sf), REPORT_METRICS)
    return rows.select("Modelo", "Categoria", "Temperatura", "show_group", "group_rows", "show_sub", "sub_rows",
                       "rule_before", "row_text")


@query
def group_sizes(spark, sf):
    rep = _report(spark, sf)
    return rep.groupBy("Modelo", "Categoria").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def sorted_report(spark, sf):
    rep = R.existing_columns(_report(spark, sf), R.report_columns() + ["Categoria", "Missing"])
    return R.sorted_report(rep).select("Modelo", "Categoria", "Temperatura",
                                       *[r6(F.col(f"`{m}`")).alias(m) for m in REPORT_METRICS])


@query
def best_config(spark, sf):
    o = _overall(spark, sf)
    b = R.best_per_group(o, "Modelo", "F1-Score", ["Temperatura"])
    return b.select("Modelo", "Temperatura", r6(F.col("`F1-Score`")).alias("F1-Score"))


@query
def topk_models(spark, sf):
    """Top 3 runs by accuracy (the limit is the feature); ties by model, temperature."""
    o = _overall(spark, sf)
    return o.orderBy(F.col("Accuracy").desc(), "Modelo", "Temperatura").limit(3).select(
        "Modelo", "Temperatura", r6("Accuracy").alias("Accuracy"))


@query
def display_report(spark, sf):
    """The overall report under its display headings."""
    return R.display_names(_overall(spark, sf).select("Modelo", "Temperatura", r6("Accuracy").alias("Accuracy"),
                                                      r6(F.col("`Tempo de Execucao Total (s)`")).alias("Tempo de Execucao Total (s)")))


def _read_back(spark, sf):
    """The run documents written as named files and scanned again (K2 -> S4)."""
    from scoreplane.session import ensure_checkpoint_dir
    from scoreplane.sources import files, sinks
    import uuid
    summ = classify.summary(E.counts(spark, sf), E.dimension(spark), RUN, with_classes=True)
    docs = R.evaluation_documents(summ, _meta(spark, sf))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    sinks.write_evaluation_documents(docs, root)
    return files.read_evaluation_documents(spark, root)


@query
def document_report(spark, sf):
    """Write -> scan -> flatten of the evaluation documents."""
    rep = R.flatten_categories(_read_back(spark, sf), _field_names(spark))
    return rep.select("Modelo", "Temperatura", "Categoria", *[r6(F.col(f"`{m}`")).alias(m) for m in REPORT_METRICS])


@query
def overall_csv_rows(spark, sf):
    """Rows of the overall report file (K4) from the scanned documents."""
    o = R.overall_rows(_read_back(spark, sf))
    return o.select(*[TX.fixed(TX.settled(F.col(f"`{c}`")), 4).alias(c) if c not in ("Modelo", "Temperatura") else F.col(c)
                      for c in K.REPORT_OVERALL_COLUMNS])


@query
def unified_runs(spark, sf):
    rec = A.generation_records(spark, sf)
    is_b = F.col("model").isin(A.VARIANT_B_MODELS)
    a = rec.filter(~is_b).withColumnRenamed("latency_s", "latencia_total_api_s")
    b = rec.filter(is_b).withColumnRenamed("latency_s", "latencia_api_s").withColumn(
        "api_usage_metadata", F.create_map(F.lit("images"), F.col("n_images").cast("string")))
    u = R.unify_generators(a, b)
    return u.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("latency_s")).alias("total_latency_s"),
                               F.count("api_usage_metadata").alias("n_with_usage"))


@query
def latest_run(spark, sf):
    """Each run evaluated in two modes (reference: skipped items count; then skipped
    items excluded) with different evaluation stamps; keep the latest per run.
    Both modes come from one pass over the pairs: ``mode`` is one more group key."""
    pairs = E.pairs(spark, sf, compat=True)
    modes = F.when(F.col("is_skipped"), F.array(F.lit("compat"))).otherwise(F.array(F.lit("compat"), F.lit("exclude")))
    both = pairs.select("*", F.explode(modes).alias("mode"))
    by = [*RUN, "mode"]
    m = classify.macro_average(classify.summary(classify.confusion_counts(both, by), E.dimension(spark), by), by)
    base = F.lit(1750000000).cast("long")
    later = F.when((F.col("mode") == "exclude") & (F.col("temperature") == 0.5), F.lit(3600)) \
        .when(F.col("mode") == "exclude", F.lit(-3600)).otherwise(F.lit(0))
    docs = m.select(*by, "accuracy", (base + later).alias("stamp"))
    # wall-clock UTC without the session time zone: epoch + interval on TIMESTAMP_NTZ
    ntz = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(stamp AS DECIMAL(18, 6)))")
    docs = docs.withColumn("timestamp_avaliacao", TF.iso_utc(ntz))
    lt = R.latest_per_key(docs, RUN, "stamp", ["mode"])
    return lt.select(*RUN, "mode", "timestamp_avaliacao", r6("accuracy").alias("accuracy"))


# ------------------------------------------------------------ sink layouts as rows
@query
def run_summary_rows(spark, sf):
    """Rows of the per-run summary file (K3): categories then the overall row, 4 decimals."""
    s = classify.summary_with_overall(E.summary(spark, sf), RUN)
    names = K.RUN_SUMMARY_COLUMNS
    return s.select(*RUN, F.col("category").alias(names[0]),
                    TX.fixed(TX.settled("accuracy"), 4).alias(names[1]), TX.fixed(TX.settled("f1_score_weighted"), 4).alias(names[2]),
                    TX.fixed(TX.settled("precision_weighted"), 4).alias(names[3]), TX.fixed(TX.settled("recall_weighted"), 4).alias(names[4]))


@query
def report_csv_rows(spark, sf):
    """Rows of the by-category report file (K4): fixed column order, 4 decimals."""
    rep = R.existing_columns(_report(spark, sf), K.REPORT_BY_CATEGORY_COLUMNS)
    return rep.select(*[TX.fixed(TX.settled(F.col(f"`{c}`")), 4).alias(c) if c in REPORT_METRICS else F.col(f"`{c}`")
                        for c in rep.columns])


from scoreplane.plans import file_queries  # noqa: E402, F401  registers the rows of sources and sinks
