"""Batch generation with an injected model callable, and answer parsing.

The model call is the one place Python has to run: ``mapInPandas`` hands each
task Arrow batches of assembled requests, the callable answers one request at a
time, and every error is captured as columns - a failing call never fails the
batch.  Parsing the answers afterwards is all native expressions (E10-E12).

Calls are spread over ``concurrency`` tasks, whatever the size of the request table, and
batches are kept small (``batch_rows``), as a request may carry megabytes of images.
Calls are not idempotent: persist the generated table (``write``) before using
it twice, so a recomputation never calls the model again.
"""

from __future__ import annotations

import time
from typing import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreplane import constants as K
from scoreplane.functions.jsonx import with_extracted_json

ANSWER_FIELDS = [
    T.StructField("raw_answer", T.StringType()),
    T.StructField("status_api_call", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("usage", T.MapType(T.StringType(), T.StringType())),
]
REQUEST = "request"
BATCH_ROWS = 32

Generator = Callable[[dict], dict]


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value.tolist() if hasattr(value, "tolist") else value


def _call_partition(generate: Generator, keys: Sequence[str], batch_rows: int):
    def answer(request: dict) -> tuple:
        started = time.perf_counter()
        try:
            resp = generate(_plain(request)) or {}
            err = resp.get("error")
            return (resp.get("response"), K.CALL_FAILED if err else K.CALL_OK, err,
                    resp.get("latency_s", time.perf_counter() - started),
                    {str(k): str(v) for k, v in (resp.get("usage") or {}).items()})
        except Exception as exc:  # per-row error capture
            return None, K.CALL_FAILED, f"{type(exc).__name__}: {exc}", time.perf_counter() - started, {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                part = batch.slice(a, batch_rows)
                answers = [answer(part[REQUEST][i].as_py(maps_as_pydicts="lossy")) for i in range(part.num_rows)]
                columns = [pa.array([r[c] for r in answers], kind) for c, kind in enumerate(
                    (pa.string(), pa.string(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), *columns],
                                                 names=[*keys, *(f.name for f in ANSWER_FIELDS)])
    return run


def batch_generate(requests: DataFrame, generate: Generator, concurrency: int, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """One model call per request row (I1).  ``requests`` has the struct ``request``
    (:func:`scoreplane.operators.grid.request_struct`); every other column is a key that comes back
    with the answer, so answers are never joined to their requests again."""
    keys = [c for c in requests.columns if c != REQUEST]
    schema = T.StructType([requests.schema[k] for k in keys] + ANSWER_FIELDS)
    return requests.repartition(concurrency).mapInArrow(_call_partition(generate, keys, batch_rows), schema)


def generation_status(api_col: Column, parsed: Column, dir_found: Column | None = None) -> Column:
    """First hit wins: directory -> API -> parse -> success."""
    parsed_ok = parsed.isNotNull() & F.coalesce(F.size(parsed) > 0, F.lit(False))
    status = F.when(api_col.isNull() | (api_col != K.CALL_OK), F.lit(K.STATUS_API_ERROR)) \
        .when(~parsed_ok, F.lit(K.STATUS_PARSE_ERROR)).otherwise(F.lit(K.STATUS_OK))
    if dir_found is not None:
        status = F.when(~dir_found, F.lit(K.STATUS_DIR_MISSING)).otherwise(status)
    return status


def parse_answers(records: DataFrame, raw_col: str = "raw_answer", api_col: str = "status_api_call",
                  dir_found: Column | None = None) -> DataFrame:
    """Adds ``parsed`` (map), ``json_parsing_error_msg``, ``status_json_parsing`` and
    ``status_geracao`` to raw generation records."""
    if dir_found is None:
        dir_found = F.col(api_col).isNotNull()
    out = with_extracted_json(records, raw_col)
    ok = F.col("parsed").isNotNull() & F.coalesce(F.size("parsed") > 0, F.lit(False))
    return out.select(
        "*",
        F.when(ok, F.lit(K.CALL_OK)).otherwise(F.lit(K.CALL_FAILED)).alias("status_json_parsing"),
        generation_status(F.col(api_col), F.col("parsed"), dir_found).alias("status_geracao"),
    )


def usage_totals(generated: DataFrame, keys: Sequence[str] = ("prompt_chars", "response_chars"),
                 by: Sequence[str] = ("model",)) -> DataFrame:
    """Sum of numeric usage counters per group."""
    return generated.groupBy(*by).agg(
        *[F.sum(F.try_element_at("usage", F.lit(k)).try_cast("long")).alias(k) for k in keys],
        F.count(F.lit(1)).alias("n_calls"))


def run_grid(items: DataFrame, models: Sequence[str], temperatures: Sequence[float], generate: Generator,
             concurrency: int, dirs: DataFrame | None = None, files: DataFrame | None = None,
             id_col: str = "request_id", entity_col: str = "entity_id", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """End-to-end grid generation (I2): grid (J2) -> directory match (J6) -> images
    -> image check (F8) -> request (P10) -> model call (I1) -> strict parse (E10-E12) -> status (F3).

    ``items`` has ``id_col``, ``system`` and ``prompt``, and either ``images`` (data URLs) or ``entity_col``,
    to be matched with ``dirs`` (dir_name) and ``files`` (path, content).  An item without a directory or
    without images is kept with its error text and never sent to the model.  Directories and images are
    matched once per item, before the grid multiplies it.  Persist the result
    (``sinks.write_generation_run``) before using it twice."""
    from scoreplane.operators.grid import encoded_images, experiment_grid, image_check, match_directories, request_struct

    if dirs is not None:
        match = match_directories(items.select(entity_col).distinct(), dirs, entity_col=entity_col)
        items = items.join(match.select(entity_col, "dir"), entity_col, "left")
        if files is not None:
            items = items.drop("images").join(encoded_images(files), "dir", "left")
        missing = F.when(F.col("dir").isNull(), F.concat(F.lit(K.ERR_DIR_MISSING[0]), F.coalesce(entity_col, F.lit("")),
                                                         F.lit(K.ERR_DIR_MISSING[1])))
    else:
        missing = F.lit(None).cast("string")
    items = items.withColumn("_unsent", F.coalesce(missing, image_check("images"))).withColumn("_found", missing.isNull())
    grid = experiment_grid(items, models, temperatures)
    keys = [id_col, "model", "temperature", "n_images", "_found"]
    grid = grid.withColumn("n_images", F.coalesce(F.size("images"), F.lit(0)))
    ready = grid.filter(F.col("_unsent").isNull()).select(*keys, request_struct(
        F.col("model"), F.col("temperature"), F.col("system"), F.col("prompt"), F.col("images")).alias(REQUEST))
    sent = batch_generate(ready, generate, concurrency, batch_rows)
    unsent = grid.filter(F.col("_unsent").isNotNull()).select(
        *keys, F.lit(None).cast("string").alias("raw_answer"),
        F.when(F.col("_found"), F.lit(K.CALL_FAILED)).alias("status_api_call"), F.col("_unsent").alias("error_message"),
        F.lit(None).cast("double").alias("latency_s"), F.lit(None).cast("map<string,string>").alias("usage"))
    return parse_answers(sent.unionByName(unsent), dir_found=F.col("_found")).drop("_found")


def preflight(items: DataFrame, n: int, generate: Generator, dirs: DataFrame, files: DataFrame, model: str,
              temperature: float = 0.0, id_col: str = "request_id", entity_col: str = "entity_id") -> DataFrame:
    """Pre-flight over the first ``n`` items by key (I4): directory found, images found, and the first item that
    has both processed by one model call.  (id, check, ok, detail)."""
    first = items.orderBy(id_col).limit(n)
    made = run_grid(first, [model], [temperature], lambda request: {"response": None}, 1, dirs, files, id_col, entity_col)
    state = made.select(id_col, (F.col("status_geracao") != K.STATUS_DIR_MISSING).alias("found"), "n_images", "error_message")
    ready = first.join(state.filter("found AND n_images > 0").select(id_col).orderBy(id_col).limit(1), id_col, "left_semi")
    called = run_grid(ready, [model], [temperature], generate, 1, dirs, files, id_col, entity_col)
    checks = state.select(id_col, F.explode(F.array(
        F.struct(F.lit("directory_found").alias("check"), F.col("found").alias("ok"),
                 F.when(~F.col("found"), F.col("error_message")).alias("detail")),
        F.struct(F.lit("images_found").alias("check"), (F.col("n_images") > 0).alias("ok"),
                 F.col("n_images").cast("string").alias("detail")))).alias("c")).select(id_col, "c.*")
    return checks.unionByName(called.select(id_col, F.lit("item_processed").alias("check"),
                                            (F.col("status_geracao") == K.STATUS_OK).alias("ok"),
                                            F.col("status_geracao").alias("detail")))
