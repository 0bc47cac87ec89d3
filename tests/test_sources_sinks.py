import json
import os
import tempfile
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from scoreplane.operators import classify, reports as R
from scoreplane.operators.grid import catalogue_from_json, images_per_directory, match_directories
from scoreplane.sources import files, sinks


def tmpdir():
    return tempfile.mkdtemp(prefix="scoreplane-test-")


def test_ground_truth_csv(spark):
    d = tmpdir()
    p = os.path.join(d, "gt.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('#,Título,estrutura,benfeitorias\n')
        f.write('5,"Casa, grande | x",ALVENARIA ,"Piscina, Sauna"\n')
        f.write('7,"Apto ""novo""",NA,\n')
        f.write('9,"multi\nline",Concreto,None\n')
    df = files.read_ground_truth_csv(spark, p, ["#", "Título", "estrutura", "benfeitorias"])
    rows = df.orderBy("dataset_idx").collect()
    assert [r["dataset_idx"] for r in rows] == [0, 1, 2]
    assert rows[0]["Título"] == "Casa, grande | x" and rows[1]["Título"] == 'Apto "novo"'
    assert rows[1]["estrutura"] is None and rows[1]["benfeitorias"] is None and rows[2]["benfeitorias"] is None
    assert rows[2]["Título"] == "multi\nline"


def test_generation_documents_both_schemas(spark):
    d = tmpdir()
    a = {"metadata_geracao_run": {"modelo_usado": "m:1", "temperatura_usada": 0.0, "timestamp_final_run": 12.5},
         "resultados_gerados_run": [{"dataset_idx": 0, "latencia_total_api_s": 1.5, "status_geracao": "processado_com_sucesso",
                                     "resposta_modelo_parsed_dict": {"Estrutura": "Alvenaria"}}]}
    b = {"metadata_geracao_run": {"modelo_usado": "g", "temperatura_usada": 0.5, "timestamp_total_run": 3.0},
         "resultados_gerados_run": [{"dataset_idx": 1, "latencia_api_s": 2.0, "api_usage_metadata": {"tokens": "10"},
                                     "status_geracao": "erro_api"}]}
    for i, doc in enumerate([a, b]):
        with open(os.path.join(d, f"run{i}.json"), "w") as f:
            json.dump(doc, f, indent=2)
    df = files.read_generation_runs(spark, d)
    rows = {r["model"]: r for r in df.collect()}
    assert rows["m:1"]["latency_s"] == 1.5 and rows["g"]["latency_s"] == 2.0
    assert rows["m:1"]["run_time_s"] == 12.5 and rows["g"]["run_time_s"] == 3.0
    assert rows["m:1"]["parsed"]["Estrutura"] == "Alvenaria"


def test_evaluation_documents_roundtrip_and_corrupt_skip(spark):
    pairs = spark.createDataFrame(
        [("m/x:1", 0.5, "Size Band", "a", "a"), ("m/x:1", 0.5, "Size Band", "b", "a")],
        "model string, temperature double, field string, y_true string, y_pred string")
    from scoreplane.operators.pairs import FieldSpec, field_dimension
    dim = field_dimension(spark, [FieldSpec("Size Band", "s", ["a", "b"])])
    lt = classify.label_table(classify.confusion_counts(pairs), dim)
    docs = R.evaluation_documents(classify.summary_from_labels(lt, with_classes=True))
    root = tmpdir()
    sub = os.path.join(root, "nested")
    sinks.write_evaluation_documents(docs, sub)
    assert sorted(n for n in os.listdir(sub) if not n.startswith(".")) == ["evaluation_metrics_m_x_1_temp_0p5.json"]
    with open(os.path.join(sub, "evaluation_metrics_m_x_1_temp_0p5.json"), encoding="utf-8") as f:
        doc = json.load(f)
    assert doc["metadata_avaliacao"]["modelo_avaliado"] == "m/x:1" and doc["metadata_avaliacao"]["temperatura"] == 0.5
    block = doc["Metricas_Agregadas_Por_Categoria"]["Size_Band"]
    assert block["accuracy"] == 0.5 and block["metrics_per_class"]["a"]["support_ground_truth"] == 1
    assert doc["Metricas_Agregadas_Por_Categoria"]["Metricas_Medias_Gerais_Do_Modelo_m_x_1"]["accuracy_m_x_1"] == 0.5
    with open(os.path.join(root, "evaluation_metrics_bad_temp_0p0.json"), "w") as f:
        f.write("{not json")
    read = files.read_evaluation_documents(spark, root)
    assert read.count() == 1
    flat = R.flatten_categories(read).collect()
    assert len(flat) == 1 and flat[0]["Categoria"] == "Size_Band" and flat[0]["Accuracy"] == 0.5
    assert flat[0]["Modelo"] == "m/x_1"  # '/' kept, its averages row is not lost
    over = R.overall_rows(read).collect()
    assert len(over) == 1 and over[0]["Accuracy"] == 0.5


def test_scan_equals_the_report_in_memory_and_writes_both_files(spark, sf_small):
    from scoreplane.plans import evaluation as E, queries as Q

    lt = classify.label_table(E.counts(spark, sf_small), E.dimension(spark))
    meta = Q._meta(spark, sf_small)
    root, out = tmpdir(), tmpdir()
    sinks.write_evaluation_documents(
        R.evaluation_documents(classify.summary_from_labels(lt, with_classes=True), meta), root)
    names = E.dimension(spark).select("field")
    cols = ["Modelo", "Temperatura", "category_key", "Categoria", "Accuracy", "F1-Score", "Precision", "Recall"]

    def bag(df, c):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    docs = files.read_evaluation_documents(spark, root)
    assert bag(R.flatten_categories(docs, names), cols) == bag(Q._report(spark, sf_small), cols)
    whole = ["Modelo", "Temperatura", "Accuracy", "F1-Score", "Precision", "Recall", "Tempo de Execucao Total (s)"]
    assert bag(R.overall_rows(docs), whole) == bag(Q._overall(spark, sf_small), whole)
    assert sinks.write_reports(spark, root, out, names) == (True, True)
    lines = []
    folder = os.path.join(out, "report_metrics_by_category")
    for n in sorted(x for x in os.listdir(folder) if x.startswith("part-")):
        with open(os.path.join(folder, n), encoding="utf-8") as f:
            lines += f.read().splitlines()[1:]
    assert len(lines) == 36 and lines == sorted(lines)


def test_identity_falls_back_to_the_file_name(spark):
    root = tmpdir()
    block = {"Metricas_Agregadas_Por_Categoria": {"Piso": {"accuracy": 0.5}}}
    for name, head in (("evaluation_metrics_vision-2.5-pro_temp_0p5.json", {}), ("evaluation_metrics_x.json", {}),
                       ("evaluation_metrics_a_7b_temp_0p1.json", {"modelo_avaliado": "b:7b", "temperatura": 1.0})):
        with open(os.path.join(root, name), "w") as f:
            json.dump({"metadata_avaliacao": head, **block}, f)
    rows = R.flatten_categories(files.read_evaluation_documents(spark, root)).collect()
    assert sorted((r["Modelo"], r["Temperatura"]) for r in rows) == [
        ("b_7b", "1.0"), ("unknown_model", "N/A"), ("vision-2.5-pro", "0.5")]


def test_text_rows_keep_order_and_rule_lines(spark):
    d = tmpdir()
    rep = spark.createDataFrame([(m, c, "0.5", 0.5) for m in ["b", "a", "c"] for c in ["y", "x"]],
                                "Modelo string, Categoria string, Temperatura string, Accuracy double")
    sinks.write_text_rows(R.report_rows(rep, ["Accuracy"]), os.path.join(d, "t"), ["Modelo", "Categoria", "Temperatura"])
    lines = []
    for n in sorted(x for x in os.listdir(os.path.join(d, "t")) if x.startswith("part-")):
        with open(os.path.join(d, "t", n)) as f:
            lines += f.read().splitlines()
    assert [("midrule" in x) for x in lines] == [False, False, True, False, False, True, False, False]
    assert "{a}" in lines[0] and "{b}" in lines[3] and "{c}" in lines[6]


def test_summary_file_ends_with_the_overall_row(spark):
    d = tmpdir()
    summ = spark.createDataFrame([("m", 0.0, f, v, v, v, v, None) for f, v in (("B", 0.5), ("A", 1.0), ("C", 0.0))],
                                 "model string, temperature double, field string, accuracy double, f1_score_weighted double, "
                                 "precision_weighted double, recall_weighted double, error string")
    metrics = ["accuracy", "f1_score_weighted", "precision_weighted", "recall_weighted"]
    sinks.write_summary_csv(classify.summary_with_overall(summ), d, metrics, partition_cols=["model", "temperature"],
                            order_cols=["is_overall", "category"])
    folder = os.path.join(d, "model=m", "temperature=0.0")
    lines = [x for n in sorted(os.listdir(folder)) if n.endswith(".csv") for x in open(os.path.join(folder, n), encoding="utf-8")]
    assert [x.split(",")[0] for x in lines] == ["category", "A", "B", "C", "MÉDIA GERAL (Categorias)"]
    assert lines[-1].strip().endswith("0.5000,0.5000,0.5000,0.5000")


def test_latest_document_does_not_depend_on_input_order(spark):
    rows = [("m", "a", 5, {"x": 1}), ("m", "b", 5, {"x": 2}), ("m", "c", 4, {"x": 3}), ("n", "z", 1, None)]
    schema = "model string, mode string, stamp long, extra map<string,int>"
    got = {tuple(sorted((r["model"], r["mode"]) for r in R.latest_per_key(spark.createDataFrame(o, schema), ["model"], "stamp").collect()))
           for o in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(got) == 1
    tied = R.latest_per_key(spark.createDataFrame(rows, schema), ["model"], "stamp", ["mode"]).collect()
    assert {r["model"]: r["mode"] for r in tied} == {"m": "b", "n": "z"}


def test_latency_quantiles(spark):
    rec = spark.range(1, 101).selectExpr("'m' AS model", "0D AS temperature", "double(id) AS latency_s")
    assert R.latency_quantiles(rec).first()["q"] == [50.0, 90.0, 99.0]


def test_list_images_of_empty_and_several_folders(spark):
    a, b, c = tmpdir(), tmpdir(), tmpdir()
    for d, n in ((a, "1.png"), (c, "2.JPG"), (c, "x.txt")):
        with open(os.path.join(d, n), "wb") as f:
            f.write(b"x")
    assert files.list_images(spark, b).count() == 0
    assert files.list_images(spark, os.path.join(b, "missing")).count() == 0
    assert sorted(os.path.basename(r["path"]) for r in files.list_images(spark, [a, b, c]).collect()) == ["1.png", "2.JPG"]


def test_generation_run_is_stored_once_with_typed_runs(spark):
    from scoreplane.operators.generate import run_grid

    seen = spark.sparkContext.accumulator(0)

    def generate(request):
        seen.add(1)
        return {"response": '{"a": 1}'}

    items = spark.createDataFrame([(i, "s", "p", ["data:x"]) for i in range(6)],
                                  "request_id long, system string, prompt string, images array<string>")
    d = tmpdir()
    stored = sinks.write_generation_run(run_grid(items, ["2024", "007"], [0.0], generate, 3), os.path.join(d, "run"))
    assert sorted(r[0] for r in stored.select("model").distinct().collect()) == ["007", "2024"]
    assert stored.count() == 12 and seen.value == 12
    meta = spark.read.json(os.path.join(d, "run", "metadata")).collect()
    assert len(meta) == 2 and all(0 < m["timestamp_final_run"] < 600 and m["n_success"] == 6 for m in meta)


def test_read_evaluation_documents_skips_corrupt(spark):
    root = tmpdir()
    good = {"metadata_avaliacao": {"modelo_avaliado": "m", "temperatura": 0.0},
            "Metricas_Agregadas_Por_Categoria": {
                "Piso": {"accuracy": 0.5, "precision_weighted": 0.4, "recall_weighted": 0.5, "f1_score_weighted": 0.45,
                         "labels_used_for_metrics": ["a"], "metrics_per_class": {"a": {"precision": 1.0}}},
                "Forro": {"error": "Sem dados"},
                "Metricas_Medias_Gerais_Do_Modelo_m": {"accuracy_m": 0.5, "num_categories_in_m": 1}}}
    os.makedirs(os.path.join(root, "a", "b"))
    with open(os.path.join(root, "a", "b", "evaluation_metrics_m_temp_0p0.json"), "w") as f:
        json.dump(good, f, indent=2)
    with open(os.path.join(root, "evaluation_metrics_z_temp_0p0.json"), "w") as f:
        f.write("{broken")
    with open(os.path.join(root, "other.json"), "w") as f:
        f.write("{}")
    docs = files.read_evaluation_documents(spark, root)
    assert docs.count() == 1
    e = docs.select("file_name", F.explode("Metricas_Agregadas_Por_Categoria").alias("k", "v"))
    e = e.filter(F.col("v.error").isNull() & ~F.startswith("k", F.lit("Metricas_Medias_Gerais_Do_Modelo_")))
    assert [r["k"] for r in e.collect()] == ["Piso"]
    av = files.read_evaluation_averages(spark, root).first()
    assert av["averages"]["accuracy_m"] == 0.5


def test_images_prompts_catalogue(spark):
    d = tmpdir()
    for n in ["a.JPG", "b.png", "c.txt", "d.WebP"]:
        with open(os.path.join(d, n), "wb") as f:
            f.write(b"xx")
    os.makedirs(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "e.jpg"), "wb") as f:
        f.write(b"x")
    imgs = files.list_images(spark, d)
    assert sorted(os.path.basename(r["path"]) for r in imgs.collect()) == ["a.JPG", "b.png", "d.WebP"]
    per_dir = images_per_directory(imgs).first()
    assert per_dir["images"] == ["a.JPG", "b.png", "d.WebP"]
    p = os.path.join(d, "prompt.txt")
    with open(p, "w") as f:
        f.write("line1\nline2\n")
    assert files.read_prompt(spark, p).first()["value"] == "line1\nline2\n"
    cat = spark.createDataFrame([('{"models": [{"name": "x:1"}, {"name": "y"}, {"name": "x:1"}]}',)], "value string")
    assert sorted(r[0] for r in catalogue_from_json(cat).collect()) == ["x:1", "y"]


def test_directory_match_underscore_ids(spark):
    ent = spark.createDataFrame([("12",), ("1",), ("7_a",), ("9",)], "entity_id string")
    dirs = spark.createDataFrame([("12",), ("12_x",), ("1_b",), ("1_a",), ("7_a_z",), ("99_q",)], "dir_name string")
    got = {r["entity_id"]: (r["dir"], r["match_kind"]) for r in match_directories(ent, dirs).collect()}
    assert got == {"12": ("12", "exact"), "1": ("1_a", "prefix"), "7_a": ("7_a_z", "prefix"), "9": (None, "none")}


def test_sinks_csv_text(spark):
    d = tmpdir()
    df = spark.createDataFrame([("m", "A", 0.125), ("m", "B", 0.5)], "Modelo string, Categoria string, Accuracy double")
    assert sinks.write_report_csv(df, os.path.join(d, "rep"), ["Modelo", "Categoria", "Accuracy", "Missing"],
                                  ["Accuracy"])
    back = spark.read.option("header", True).csv(os.path.join(d, "rep")).orderBy("Categoria").collect()
    assert [r["Accuracy"] for r in back] == ["0.1250", "0.5000"]
    assert not sinks.write_report_csv(df.limit(0), os.path.join(d, "empty"), ["Modelo"], [])
    sinks.write_text_rows(df.withColumn("row_text", F.concat_ws(" & ", "Categoria", "Modelo")), os.path.join(d, "t"),
                          ["Categoria"])
    lines = [r[0] for r in spark.read.text(os.path.join(d, "t")).collect()]
    assert sorted(lines) == ["A & m", "B & m"]
    sinks.write_summary_csv(df, os.path.join(d, "s"), ["Accuracy"], partition_cols=["Modelo"])
    assert os.path.isdir(os.path.join(d, "s", "Modelo=m"))


def test_generation_items_sink_partitioned_by_run(spark, sf_small):
    from scoreplane.plans import adapters as A

    d = tmpdir()
    rec = A.generation_records(spark, sf_small)
    sinks.write_generation_items(rec, os.path.join(d, "items"), files_per_run=2)
    at = datetime(2025, 6, 19, 13, 0, 1, tzinfo=timezone.utc)
    sinks.write_run_metadata(rec, os.path.join(d, "meta"), at, at + timedelta(seconds=90))
    runs = sorted(n for n in os.listdir(os.path.join(d, "items")) if n.startswith("model="))
    assert len(runs) == 3
    back = spark.read.parquet(os.path.join(d, "items"))
    assert back.count() == rec.count()
    assert back.filter("model = 'alpha-vl:7b' AND temperature = 0.5").count() == \
        rec.filter("model = 'alpha-vl:7b' AND temperature = 0.5").count()
    meta = spark.read.json(os.path.join(d, "meta"))
    assert meta.count() == 9 and meta.agg(F.sum("total_itens_na_saida_run")).first()[0] == rec.count()


def test_image_check_keeps_items(spark):
    from scoreplane.operators.grid import image_check

    df = spark.createDataFrame([(1, ["a.jpg"]), (2, []), (3, None)], "item long, images array<string>")
    got = {r["item"]: r["err"] for r in df.select("item", image_check().alias("err")).collect()}
    assert got[1] is None and got[2] and got[3]


def test_files_per_run(spark, sf_small):
    from scoreplane.plans import adapters as A

    d = tmpdir()
    sinks.write_generation_items(A.generation_records(spark, sf_small), os.path.join(d, "items"), files_per_run=2)
    model_dir = next(n for n in os.listdir(os.path.join(d, "items")) if n.startswith("model=alpha-vl"))
    run_dir = os.path.join(d, "items", model_dir, "temperature=0.5")
    files = [n for n in os.listdir(run_dir) if n.endswith(".parquet")]
    assert 1 <= len(files) <= 2


def _items(spark, rows):
    return spark.createDataFrame(rows, "model string, temperature double, request_id long, status_geracao string")


def test_writing_one_run_leaves_the_others(spark):
    d = tmpdir()
    a = _items(spark, [("a", 0.0, i, "processado_com_sucesso") for i in range(4)])
    sinks.write_generation_items(a, os.path.join(d, "plain"))
    sinks.write_generation_items(_items(spark, [("b", 0.5, 9, "erro_api")]), os.path.join(d, "plain"))
    assert spark.read.parquet(os.path.join(d, "plain")).count() == 5
    path = os.path.join(d, "runs")
    sinks.write_generation_run(a, path)
    assert sinks.write_generation_run(_items(spark, [("b", 0.5, 9, "erro_api"), (None, 0.5, 1, "x")]), path).count() == 2
    sinks.write_generation_run(_items(spark, [("a", 0.0, 7, "erro_api")]), path)  # run a again
    back = files.read_committed_runs(spark, path, a.schema)
    want = [("a", 0.0, 7), ("b", 0.5, 9), (None, 0.5, 1)]
    assert sorted(((r.model, r.temperature, r.request_id) for r in back.collect()), key=str) == sorted(want, key=str)
    assert spark.read.json(os.path.join(path, "metadata")).count() == 3
    assert sinks.drop_replaced_attempts(spark, path, a.schema) == 1
    assert files.read_committed_runs(spark, path, a.schema).count() == 3
    assert spark.read.parquet(os.path.join(path, "items")).count() == 3


def test_a_failed_attempt_is_never_read(spark):
    path = os.path.join(tmpdir(), "runs")
    a = _items(spark, [("a:1", 0.0, i, "processado_com_sucesso") for i in range(4)])
    sinks.write_generation_run(a, path)
    a.withColumn("attempt", F.lit("broken")).write.mode("append").partitionBy("model", "temperature", "attempt").parquet(f"{path}/items")
    assert files.read_committed_runs(spark, path, a.schema).count() == 4


def test_runs_of_one_safe_name_keep_their_documents(spark):
    root = tmpdir()

    def docs(*models):
        pairs = spark.createDataFrame([(m, 0.5, "F", "a", p) for m, p in models],
                                      "model string, temperature double, field string, y_true string, y_pred string")
        from scoreplane.operators.pairs import FieldSpec, field_dimension
        dim = field_dimension(spark, [FieldSpec("F", "s", ["a", "b"])])
        return R.evaluation_documents(classify.summary_from_labels(
            classify.label_table(classify.confusion_counts(pairs), dim), with_classes=True))

    def back():
        return sorted((r.m, r.a) for r in files.read_evaluation_documents(spark, root).selectExpr(
            "metadata_avaliacao.modelo_avaliado AS m", "Metricas_Agregadas_Por_Categoria['F'].accuracy AS a").collect())
    sinks.write_evaluation_documents(docs(("org/model:7b", "a"), ("org:model/7b", "b"), ("x", "a")), root)
    assert back() == [("org/model:7b", 1.0), ("org:model/7b", 0.0), ("x", 1.0)]
    sinks.write_evaluation_documents(docs(("org_model_7b", "b"), ("x", "b")), root)  # later: another of that name, x again
    assert back() == [("org/model:7b", 1.0), ("org:model/7b", 0.0), ("org_model_7b", 0.0), ("x", 0.0)]
    sinks.write_evaluation_documents(docs(("x:1", "a"), ("org/model:7b", "b")), root)
    sinks.write_evaluation_documents(docs(("x/1", "b")), root)  # the name is owned by another run
    assert back() == [("org/model:7b", 0.0), ("org:model/7b", 0.0), ("org_model_7b", 0.0), ("x", 0.0), ("x/1", 0.0), ("x:1", 1.0)]


def test_positions_follow_the_paths_and_malformed_rows_stay(spark):
    d = tmpdir()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("k,v\n1,x\n2,y,extra\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("k,v\n" + "".join(f"{i},z\n" for i in range(50)))
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write('k,v\n8,"q, r"\n9\n')
    for multi_line in (True, False):
        rows = files.read_ground_truth_csv(spark, d, ["k", "v"], multi_line=multi_line, malformed_col="bad").orderBy(
            "dataset_idx").collect()
        assert [r.dataset_idx for r in rows] == list(range(54))
        assert [r.k for r in rows] == ["1", "2", *map(str, range(50)), "8", "9"]
        assert rows[52].v == "q, r" and {r.dataset_idx: r.bad for r in rows if r.bad is not None} == {1: "2,y,extra", 53: "9"}


def test_split_files_keep_their_positions(spark):
    d = tmpdir()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("k\n" + "".join(f"{i:09d}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_ground_truth_csv(spark, d, ["k"], multi_line=False)
        assert rows.where("INT(k) <> dataset_idx").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_documents_are_scanned_item_by_item_and_broken_ones_skipped(spark):
    d = tmpdir()
    rows = spark.createDataFrame([(f"run{i % 3}.json", i, i * 0.5, f'raw {{\n    {{ "{i}" ] \\ end') for i in range(30)],
                                 "file_name string, i long, latency double, raw string")
    items = rows.select("file_name", "i", F.struct(
        F.col("i").alias("dataset_idx"), F.col("latency").alias("latencia_api_s"), F.col("raw").alias("resposta_modelo_raw_str"),
        F.create_map(F.lit("k"), F.col("raw")).alias("resposta_modelo_parsed_dict")).alias("item"))
    meta = rows.select("file_name").distinct().select("file_name", F.struct(
        F.col("file_name").alias("modelo_usado"), F.lit(0.5).alias("temperatura_usada"), F.lit(3.0).alias("timestamp_total_run")).alias("meta"))
    sinks.write_run_documents(items, meta, d, "i")
    with open(os.path.join(d, "run0.json"), encoding="utf-8") as f:
        text = f.read()
    doc = json.loads(text)
    assert [x["dataset_idx"] for x in doc["resultados_gerados_run"]] == list(range(0, 30, 3))
    for name, broken in (("cut.json", text[: len(text) // 2]), ("item.json", text.replace('"dataset_idx":3', '"dataset_idx":', 1)),
                         ("head.json", text.replace('"modelo_usado"', "modelo", 1)), ("none.json", "")):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(broken)
    with open(os.path.join(d, "own.json"), "w") as f:  # as the original tool writes it, and one without items
        json.dump(doc, f, indent=2, ensure_ascii=False)
    with open(os.path.join(d, "empty.json"), "w") as f:
        json.dump(doc | {"resultados_gerados_run": []}, f, indent=2)
    got, documents = files.scan_generation_runs(spark, d)
    told = {r.file_name: (r.n_items, r.broken) for r in documents.collect()}
    assert {n for n, (_, b) in told.items() if b} == {"cut.json", "item.json", "head.json"}
    assert told["own.json"] == (10, False) and told["empty.json"] == (0, False)
    want = {(r.file_name, r.i): r for r in rows.collect()}
    found = got.collect()
    assert len(found) == 40 and all(r.raw_answer == want[r.model, r.dataset_idx].raw == r.parsed["k"]
                                    and r.latency_s == r.dataset_idx * 0.5 and r.run_time_s == 3.0 for r in found)
    assert files.read_generation_runs(spark, d).count() == 40  # the whole-document reader skips the same files


def test_image_trees_are_pruned_by_folder(spark):
    d = tmpdir()
    for folder, n in (("007", "1.png"), ("007", "2.JPG"), ("007", "x.txt"), ("b_c", "3.webp")):
        os.makedirs(os.path.join(d, f"dir={folder}"), exist_ok=True)
        with open(os.path.join(d, f"dir={folder}", n), "wb") as f:
            f.write(b"abc")
    every = files.read_image_tree(spark, d)
    assert sorted((r["dir"], os.path.basename(r.path), r.length) for r in every.collect()) == [
        ("007", "1.png", 3), ("007", "2.JPG", 3), ("b_c", "3.webp", 3)]
    chosen = spark.createDataFrame([("007",)], "dir string")
    assert files.read_image_tree(spark, d, chosen, with_content=True).select("dir", "content").distinct().count() == 1
    plan = every.where("dir = 'b_c'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dir" in plan


def test_text_rows_read_back_in_order_over_many_files(spark):
    d = tmpdir()
    rows = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("line "), "id").alias("row_text")).repartition(7)
    sinks.write_text_rows(rows, os.path.join(d, "t"), ["k"])
    back = files.read_text_rows(spark, os.path.join(d, "t"))
    assert back.where("value <> CONCAT('line ', line_no)").count() == 0 and back.count() == 5000


def test_reports_are_replaced_whole(spark):
    d = os.path.join(tmpdir(), "rep")
    one = spark.createDataFrame([("m", 0.5)], "Modelo string, Accuracy double")
    assert sinks.write_report_csv(one, d, ["Modelo", "Accuracy"], ["Accuracy"])
    assert sinks.write_report_csv(one.unionByName(one), d, ["Modelo", "Accuracy"], ["Accuracy"])
    assert spark.read.option("header", True).csv(d).count() == 2
    assert sorted(n for n in os.listdir(os.path.dirname(d)) if not n.startswith(".")) == ["rep"]
    assert not sinks.write_report_csv(one.limit(0), d, ["Modelo"], []) and not os.path.exists(d)
