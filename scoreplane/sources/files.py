"""File scans (S1-S7): explicit schemas, never inference; open keys as maps."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreplane import constants as K
from scoreplane.functions.media import extension
from scoreplane.functions.text import missing_token_to_null
from scoreplane.sources.tables import has_files, write_once

S = T.StringType()
D = T.DoubleType()
L = T.LongType()

GENERATION_ITEM = T.StructType([
    T.StructField("property_id", L), T.StructField("dataset_idx", L), T.StructField("modelo", S),
    T.StructField("temperatura_usada", D), T.StructField("search_term_folder", S),
    T.StructField("property_directory_processed", S), T.StructField("num_imagens_encontradas", T.IntegerType()),
    T.StructField("num_imagens_enviadas_api", T.IntegerType()), T.StructField("tipo_prompt", S),
    T.StructField("latencia_total_api_s", D), T.StructField("latencia_api_s", D),
    T.StructField("api_usage_metadata", T.MapType(S, S)),
    T.StructField("latencia_funcao_processamento_s", D), T.StructField("resposta_modelo_raw_str", S),
    T.StructField("resposta_modelo_parsed_dict", T.MapType(S, S)), T.StructField("status_geracao", S),
    T.StructField("status_api_call", S), T.StructField("status_json_parsing", S),
    T.StructField("json_parsing_error_msg", S), T.StructField("processing_error_msg", S),
    T.StructField("error_message", S), T.StructField("imagens_processadas_nomes", T.ArrayType(S)),
])
GENERATION_META = T.StructType([
    T.StructField("timestamp_geracao_inicial_run", S), T.StructField("timestamp_geracao_final_run", S),
    T.StructField("timestamp_final_run", D), T.StructField("timestamp_total_run", D),
    T.StructField("modelo_usado", S), T.StructField("temperatura_usada", D),
    T.StructField("total_propriedades_dataset", L), T.StructField("total_itens_na_saida_run", L),
    T.StructField("dataset_usado", S), T.StructField("tipo_prompt_usado", S),
    T.StructField("system_prompt_file", S), T.StructField("human_prompt_file", S),
])
GENERATION_DOC = T.StructType([
    T.StructField("metadata_geracao_run", GENERATION_META),
    T.StructField("resultados_gerados_run", T.ArrayType(GENERATION_ITEM)),
])

CLASS_METRICS = T.StructType([
    T.StructField("precision", D), T.StructField("recall", D), T.StructField("f1-score", D),
    T.StructField("support_ground_truth", L), T.StructField("support_predicted", L),
])
CATEGORY_METRICS = T.StructType([
    T.StructField("accuracy", D), T.StructField("precision_weighted", D), T.StructField("recall_weighted", D),
    T.StructField("f1_score_weighted", D), T.StructField("error", S),
    T.StructField("labels_used_for_metrics", T.ArrayType(S)),
    T.StructField("metrics_per_class", T.MapType(S, CLASS_METRICS)),
])
EVAL_META = T.StructType([
    T.StructField("timestamp_avaliacao", S), T.StructField("arquivo_resultados_gerados_avaliado", S),
    T.StructField("dataset_ground_truth_usado", S), T.StructField("modelo_avaliado", S),
    T.StructField("temperatura", D), T.StructField("latencia_total_resposta_modelo_s", D),
    T.StructField("total_itens_avaliados", L), T.StructField("total_categorias_com_media_calculada", L),
])


def in_file_order(rows: DataFrame, columns: Sequence[str], index_col: str, name: str) -> DataFrame:
    """The columns and a 0-based position (S2): rows of a file source by path, block and place in the block.

    The rows are written once with their place, so a position never changes; the blocks' sizes then give
    the offsets (one row per file block).  No row passes through Python."""
    spots = rows.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_place"))
    placed = write_once(spots, name)
    sizes = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", "_block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return placed.join(offsets, ["_file", "_block"]).select(*[F.col(f"`{c}`") for c in columns],
                                                            (F.col("_offset") + F.col("_place")).alias(index_col))


def read_ground_truth_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                          index_col: str = "dataset_idx", multi_line: bool = True,
                          malformed_col: str | None = None) -> DataFrame:
    """S1 + S2: header CSV, all columns as text, quoted commas and multi-line cells,
    missing-value tokens -> null, plus a 0-based row-position key (consecutive, in the order of the paths).

    Where no cell spans lines, ``multi_line=False`` lets several tasks read one file.  A row with too few or too many
    cells keeps its place; ``malformed_col`` holds its text, null for a good row."""
    kept = [*columns, *([malformed_col] if malformed_col else [])]
    schema = T.StructType([T.StructField(c, S) for c in kept])
    reader = (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line).option("encoding", "UTF-8").option("enforceSchema", False))
    if malformed_col:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", malformed_col)
    told = in_file_order(reader.csv(path if isinstance(path, str) else list(path)), kept, index_col, "ground-truth")
    return told.select(*[missing_token_to_null(F.col(f"`{c}`")).alias(c) for c in columns],
                       *([F.col(f"`{malformed_col}`")] if malformed_col else []), index_col)


def _generation_items(docs: DataFrame, item: str = "it", meta: str = "metadata_geracao_run") -> DataFrame:
    m = F.col(meta)
    return docs.select(
        m["modelo_usado"].alias("model"), m["temperatura_usada"].alias("temperature"),
        F.coalesce(m["timestamp_final_run"], m["timestamp_total_run"]).alias("run_time_s"),
        f"{item}.*",
    ).withColumn("latency_s", F.coalesce("latencia_total_api_s", "latencia_api_s")) \
     .withColumnRenamed("resposta_modelo_parsed_dict", "parsed") \
     .withColumnRenamed("resposta_modelo_raw_str", "raw_answer")


def _whole_documents(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*GENERATION_DOC.fields, T.StructField("_corrupt_record", S)])
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def read_generation_runs(spark: SparkSession, path: str) -> DataFrame:
    """S3 + U3: nested run documents -> one row per item with run metadata; both
    generator schemas land in one shape (twin columns coalesced).  A broken document is skipped.

    Each document is one record here, whatever its layout; :func:`scan_generation_runs` reads large ones item by item."""
    docs = _whole_documents(spark, path).filter(F.col("_corrupt_record").isNull())
    return _generation_items(docs.select("metadata_geracao_run", F.explode("resultados_gerados_run").alias("it")))


#: Where the next item of an indented run document begins: a line break is escaped inside JSON strings, so only an
#: object of the item list starts a line at this depth.
ITEM_BREAK = "\n    {"


def scan_generation_runs(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """S3 for indented run documents of any size: (items, documents).

    A file is read as one record per item, by several tasks where it is large, and never as a whole.  documents has a row per file:
    file_name, n_items, broken.  A document is broken if its metadata or one of its items doesn't parse or its end is
    missing; none of its items is returned, and the other documents are not touched."""
    chunks = (spark.read.option("lineSep", ITEM_BREAK).option("pathGlobFilter", pattern).text(path)
              .select("value", F.col("_metadata.file_path").alias("file")))
    end = r"\n  \]\s*\}\s*$"
    head = F.col("value").rlike(r"^\s*\{")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}

    def parsed(text, schema: T.StructType):
        return F.from_json(text, T.StructType([*schema.fields, T.StructField("_corrupt_record", S)]), options)

    item = F.concat(F.lit("{"), F.regexp_replace(F.regexp_replace("value", end, ""), r",\s*$", ""))
    whole_head = F.regexp_replace("value", r'"resultados_gerados_run":\s*\[\s*$', '"resultados_gerados_run": []}')
    told = chunks.select(
        "file", head.alias("head"), F.when(head, F.col("value").rlike(r"\[\s*\]\s*\}\s*$")).otherwise(
            F.col("value").rlike(end)).alias("last"),
        F.when(head, parsed(whole_head, GENERATION_DOC)).alias("doc"), F.when(~head, parsed(item, GENERATION_ITEM)).alias("it"))
    bad = F.when(F.col("head"), F.col("doc._corrupt_record").isNotNull() | F.col("doc.metadata_geracao_run").isNull()).otherwise(
        F.col("it._corrupt_record").isNotNull() | F.col("it").isNull())
    documents = told.groupBy("file").agg(
        F.max("doc.metadata_geracao_run").alias("meta"), F.count_if(~F.col("head")).alias("n_items"),
        (F.count_if(bad) + F.abs(F.count_if("head") - 1) + F.abs(F.count_if("last") - 1) > 0).alias("broken"))
    good = documents.filter("NOT broken").select("file", F.col("meta").alias("metadata_geracao_run"))
    items = _generation_items(told.filter("NOT head").select("file", "it").join(good, "file")).drop("_corrupt_record")
    return items, documents.select(F.element_at(F.split("file", "/"), -1).alias("file_name"), "n_items", "broken")


def read_committed_runs(spark: SparkSession, path: str, schema: T.StructType,
                        run_cols: Sequence[str] = ("model", "temperature")) -> DataFrame:
    """The items of the attempts that the runs' metadata name (K1): a run that is being written again shows its former items
    until the new ones are committed.  ``attempt`` prunes partitions."""
    items = spark.read.schema(T.StructType([*schema.fields, T.StructField("attempt", S)])).parquet(f"{path}/items")
    runs = T.StructType([*[schema[c] for c in run_cols], T.StructField("attempt", S)])
    committed = spark.read.schema(runs).json(f"{path}/metadata").select(*[F.col(c).alias(f"_{c}") for c in runs.names])
    same = [items[c].eqNullSafe(committed[f"_{c}"]) for c in run_cols]
    return items.join(committed, [items["attempt"] == committed["_attempt"], *same], "left_semi").drop("attempt")


def read_evaluation_documents(spark: SparkSession, root: str, pattern: str = "evaluation_metrics_*.json") -> DataFrame:
    """Every evaluation document under ``root`` (recursive), unreadable files skipped: its metadata, the
    categories as a typed map, the averages (keys suffixed by the model name) as a map of numbers, and the file
    name for lineage and fallbacks (E5).  Every file is read once."""
    schema = T.StructType([
        T.StructField("metadata_avaliacao", EVAL_META),
        T.StructField("Metricas_Agregadas_Por_Categoria", T.MapType(S, S)),
        T.StructField("_corrupt_record", S),
    ])
    df = (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(root))
    df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
    df = df.filter(F.col("_corrupt_record").isNull() & F.col("Metricas_Agregadas_Por_Categoria").isNotNull())
    blocks = F.map_entries("Metricas_Agregadas_Por_Categoria")

    def is_average(e):
        return F.startswith(e["key"], F.lit(K.AVERAGES_KEY_PREFIX))
    typed = F.transform(F.filter(blocks, lambda e: ~is_average(e)), lambda e: F.struct(
        e["key"].alias("key"), F.from_json(e["value"], CATEGORY_METRICS).alias("value")))
    average = F.try_element_at(F.filter(blocks, is_average), F.lit(1))["value"]
    numbers = F.map_filter(F.transform_values(F.from_json(average, T.MapType(S, S)), lambda k, v: v.try_cast("double")),
                           lambda k, v: v.isNotNull())
    return df.select("file_name", "metadata_avaliacao", F.map_from_entries(typed).alias("Metricas_Agregadas_Por_Categoria"),
                     numbers.alias("averages"))


def read_evaluation_averages(spark: SparkSession, root: str, pattern: str = "evaluation_metrics_*.json") -> DataFrame:
    """The averages block of each document as ``(file_name, model, averages MAP<STRING, DOUBLE>)``."""
    d = read_evaluation_documents(spark, root, pattern).filter(F.col("averages").isNotNull())
    return d.select("file_name", F.col("metadata_avaliacao.modelo_avaliado").alias("model"), "averages")


def read_report_csv(spark: SparkSession, path: str, text_cols: Sequence[str], number_cols: Sequence[str]) -> DataFrame:
    """A report CSV with explicit types; unparsable numbers become null."""
    schema = T.StructType([T.StructField(c, S) for c in [*text_cols, *number_cols]])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in text_cols],
                     *[F.col(f"`{c}`").try_cast("double").alias(c) for c in number_cols])


IMAGE_FILE = T.StructType([T.StructField("path", S), T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", L), T.StructField("content", T.BinaryType())])


def list_images(spark: SparkSession, directories: str | Sequence[str], with_content: bool = False) -> DataFrame:
    """Direct children of the directories with an image extension (case-insensitive); none where a directory
    is empty.

    ``binaryFile`` lists lazily; only ``path`` / ``length`` are read unless the
    bytes are asked for (column pruning skips the content)."""
    roots = [d.rstrip("/") for d in ([directories] if isinstance(directories, str) else directories)]
    cols = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    filled = [d for d in roots if has_files(spark, d)]
    if not filled:
        return spark.createDataFrame([], IMAGE_FILE).select(*cols)
    df = spark.read.format("binaryFile").load([f"{d}/*" for d in filled])
    parent = F.regexp_extract("path", r"^(?:[a-z]+:/*(?=/))?(.*)/[^/]+$", 1)
    bare = [d.split("://")[-1].removeprefix("file:") for d in filled]
    keep = F.lit(False)
    for d in bare:
        keep = keep | parent.endswith(d)
    return df.filter(keep & extension("path").isin(K.IMAGE_EXTENSIONS)).select(*cols)


def read_image_tree(spark: SparkSession, base: str, chosen: DataFrame | None = None, dir_col: str = "dir",
                    with_content: bool = False) -> DataFrame:
    """S6 below folders named ``<dir_col>=<name>``: (dir, path, length[, content]) of the image files in them.

    The folder is a partition column, so a filter on it, or the join with ``chosen`` (a table with the folders wanted), prunes
    the listing; content is read only where it is asked for."""
    schema = T.StructType([*IMAGE_FILE.fields, T.StructField(dir_col, S)])
    df = spark.read.format("binaryFile").schema(schema).option("basePath", base).load(base)
    df = df.filter(extension("path").isin(K.IMAGE_EXTENSIONS))
    if chosen is not None:
        df = df.join(chosen.select(dir_col), dir_col, "left_semi")
    return df.select(dir_col, "path", "length", *(["content"] if with_content else []))


def read_text_rows(spark: SparkSession, path: str, index_col: str = "line_no") -> DataFrame:
    """The lines of a text report (K5) with their place in the whole, across its files."""
    return in_file_order(spark.read.text(path), ["value"], index_col, "text-rows")


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text value each, with the partition columns of their folders; empty files are dropped."""
    df = spark.read.text(path, wholetext=True)
    return df.filter(F.length("value") > 0).select(F.col("_metadata.file_name").alias("file_name"), *df.columns)
