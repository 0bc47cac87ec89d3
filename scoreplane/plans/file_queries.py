"""Registered rows of the sources and sinks: each writes files from the shared tables with Spark, scans them again with
the library and returns what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.operators import classify, ledger
from scoreplane.operators import grid as G
from scoreplane.operators import reports as R
from scoreplane.plans import adapters as A
from scoreplane.plans import evaluation as E
from scoreplane.plans import queries as Q
from scoreplane.sources import files, sinks
from scoreplane.sources.tables import fresh_folder, read_table, touch

RUN = Q.RUN


@Q.query
def rewritten_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run is stored, then one model's runs are made again with their good items only; all are read back (K1)."""
    rec = A.generation_records(spark, sf).select("model", "temperature", "property_id", "status_geracao")
    path = fresh_folder(spark, "runs")
    sinks.write_generation_run(rec, path, files_per_run=4)
    again = rec.filter((F.col("model") == A.MODELS[0]) & (F.col("status_geracao") == K.STATUS_OK))
    sinks.write_generation_run(again, path, files_per_run=4)
    back = files.read_committed_runs(spark, path, rec.schema)
    return back.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("property_id").alias("n_properties"),
                                  F.count_if(F.col("status_geracao") == K.STATUS_OK).alias("n_success"))


@Q.query
def resumed_generation(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of one model is answered, then the whole grid over the same ledger: the first job's calls are not made again."""
    def requests(models):
        return G.experiment_grid(Q._prompts(spark, sf), models, A.TEMPERATURES).select("request_id", *RUN, G.request_struct(
            F.col("model"), F.col("temperature"), F.col("system"), F.col("prompt")).alias("request"))
    path = fresh_folder(spark, "ledger")
    ledger.resume(requests(A.MODELS[:1]), Q.stub_generate, path, "first", calls_per_task=512, batch_rows=64)
    out = ledger.resume(requests(A.MODELS), Q.stub_generate, path, "second", calls_per_task=512, batch_rows=64)
    return out.select("request_id", *RUN, "status_api_call", "raw_answer", "job")


@Q.query
def truth_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as CSV files of unequal size with quoted commas and rows of too many cells; positions over all files."""
    size = F.col("p_size")
    text = F.replace(F.concat("p_name", F.lit(", "), "p_type"), F.lit('"'), F.lit('""'))
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), text, F.lit('"'), F.when(size == 7, F.lit(",more")).otherwise(F.lit("")))
    chunk = F.when(size < 5, F.lit("a")).when(size < 25, F.lit("b")).otherwise(F.lit("c"))
    part = read_table(spark, sf, "part").select("p_partkey", chunk.alias("chunk"), line.alias("key,name"))
    root = fresh_folder(spark, "truth")
    part.repartitionByRange("chunk", "p_partkey").sortWithinPartitions("chunk", "p_partkey").select("chunk", "`key,name`").write.option(
        "header", True).option("sep", "\x01").option("quote", "").option("escapeQuotes", False).partitionBy("chunk").csv(root)
    rows = files.read_ground_truth_csv(spark, f"{root}/chunk=*", ["key", "name"], multi_line=False, malformed_col="malformed")
    return rows.select(F.col("key").cast("bigint").alias("p_partkey"), "dataset_idx", "name",
                       F.col("malformed").isNotNull().alias("malformed"))


@Q.query
def scanned_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run as a nested document, and one broken document beside them; scanned item by item (S3)."""
    rec = A.generation_records(spark, sf)
    name = F.concat(F.lit("run_"), F.translate("model", ":/", "__"), F.lit("_"), F.col("temperature").cast("string"), F.lit(".json"))
    named = rec.withColumn("file_name", name)
    items = named.select("file_name", "property_id", F.struct(
        "property_id", "dataset_idx", F.col("model").alias("modelo"), F.col("latency_s").alias("latencia_total_api_s"),
        F.col("raw_answer").alias("resposta_modelo_raw_str"), F.col("parsed").alias("resposta_modelo_parsed_dict"),
        "status_geracao", "status_api_call").alias("item"))
    meta = named.groupBy("file_name", *RUN).agg(F.count(F.lit(1)).alias("n")).select("file_name", F.struct(
        F.col("model").alias("modelo_usado"), F.col("temperature").alias("temperatura_usada"),
        F.col("n").alias("total_itens_na_saida_run"), F.lit(1.5).alias("timestamp_total_run")).alias("meta"))
    root = fresh_folder(spark, "documents")
    sinks.write_run_documents(items, meta, root, "property_id")
    cut = '{\n  "metadata_geracao_run": {"modelo_usado": "cut"},\n  "resultados_gerados_run": [\n    {\n      "property_id": 1'
    touch(spark, f"{root}/broken.json", cut)
    found, documents = files.scan_generation_runs(spark, root)
    runs = found.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_items"), F.count("parsed").alias("n_parsed"), F.sum(F.length("raw_answer")).alias("raw_chars"),
        Q.r6(F.sum("latency_s")).alias("latency_s"), F.max("run_time_s").alias("run_time_s"))
    none = {"temperature": "double", "n_parsed": "bigint", "raw_chars": "bigint", "latency_s": "double", "run_time_s": "double"}
    broken = documents.filter("broken").select(F.col("file_name").alias("model"), "n_items", *[
        F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    return runs.unionByName(broken)


def _lines(df: DataFrame, line: Column, dir_col: str, root: str, extension: str) -> None:
    df.select(dir_col, line.alias("line")).repartition(dir_col).write.mode("append").partitionBy(dir_col).option(
        "extension", extension).option("sep", "\x01").option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(root)


@Q.query
def image_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Image files and notes in a folder per hundred pages, listed for the folders that hold a page of good quality."""
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html", F.concat(
        F.lit("site_"), F.expr("page_id DIV 100").cast("string")).alias("dir"))
    root = fresh_folder(spark, "images")
    _lines(pages, F.col("url"), "dir", root, "png")
    _lines(pages, F.md5("html"), "dir", root, "JPG")
    _lines(pages, F.col("url"), "dir", root, "txt")
    good = read_table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    chosen = pages.select("page_id", "dir").join(good, "page_id", "left_semi").select("dir").distinct()
    found = files.read_image_tree(spark, root, chosen)
    return found.groupBy("dir").agg(F.count(F.lit(1)).alias("n_images"), F.sum("length").alias("bytes"))


@Q.query
def prompt_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt file per region, one of them empty, joined whole to the requests of its customers."""
    region = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name",
                                                    F.col("n_regionkey").alias("r_regionkey"))
    root = fresh_folder(spark, "prompts")
    lines = nation.join(region.filter("r_name <> 'ASIA'"), "r_regionkey").select("r_regionkey", "n_name")
    lines.repartition("r_regionkey").sortWithinPartitions("r_regionkey", "n_name").write.partitionBy("r_regionkey").text(root)
    touch(spark, f"{root}/r_regionkey={region.filter(F.col('r_name') == 'ASIA').first()[0]}/prompt.txt")
    prompts = files.read_prompt(spark, root).select("r_regionkey", "value")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey")
    return customers.join(prompts, "r_regionkey", "left").select("c_custkey", F.col("value").alias("prompt"))


@Q.query
def text_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The table text written in report order over many files and read back with its line numbers (K5)."""
    path = fresh_folder(spark, "table-text")
    sinks.write_text_rows(R.report_rows(Q._report(spark, sf), Q.REPORT_METRICS), path, ["Modelo", "Categoria", "Temperatura"])
    return files.read_text_rows(spark, path).select("line_no", F.col("value").alias("line"))


@Q.query
def run_latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Latency quantiles per model, from sketches of its runs added up; within 1 % of the exact ranks."""
    sketch = R.latency_sketch(A.generation_records(spark, sf).select(*RUN, "latency_s"))
    merged = R.merge_sketches(sketch, ["model"])
    q = R.sketch_quantiles(merged, [0.01, 0.5, 0.9, 0.99, 1.0], ["model"])
    return q.select("model", "quantile", "n", Q.r6("value").alias("value"))


@Q.query
def named_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation documents of models whose file names fold into one another, all read back."""
    summ = classify.summary(E.counts(spark, sf), E.dimension(spark), RUN, with_classes=True)
    twins = summ.withColumn("model", F.explode(F.array(F.concat("model", F.lit(":x")), F.concat("model", F.lit("/x")))))
    root = fresh_folder(spark, "named-documents")
    sinks.write_evaluation_documents(R.evaluation_documents(twins), root)
    docs = files.read_evaluation_documents(spark, root)
    e = docs.select(F.col("metadata_avaliacao.modelo_avaliado").alias("model"), F.col("metadata_avaliacao.temperatura").alias("temperature"),
                    F.explode("Metricas_Agregadas_Por_Categoria").alias("category_key", "v"))
    return e.select("model", "temperature", "category_key", Q.r6("v.accuracy").alias("accuracy"))


@Q.query
def report_csv_back(spark: SparkSession, sf: str) -> DataFrame:
    """The by-category report file written and read again with its types."""
    path = fresh_folder(spark, "report-csv")
    sinks.write_report_csv(Q._report(spark, sf), path, K.REPORT_BY_CATEGORY_COLUMNS, Q.REPORT_METRICS)
    # the file has the columns in their order
    return files.read_report_csv(spark, path, ["Modelo", "Temperatura", "Categoria"], Q.REPORT_METRICS)


@Q.query
def pattern_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of the models whose names match a pattern."""
    items = A.truth(spark, sf).select("item_id")
    return G.experiment_grid(items, Q.REQUESTED_MODELS, A.TEMPERATURES, pattern="vl:").groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_items"))
