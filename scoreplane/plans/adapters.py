"""Deterministic adapters that turn the shared test tables into evaluation inputs.

The adapters are test-data generators, not library logic: each is a list of
SQL expression *stages* in the common subset of Spark SQL and DuckDB, so the
Spark plan and the DuckDB oracle start from byte-identical inputs and only the
library's work (parsing, aligning, metrics, reports) is checked.

T1 truth        documents LEFT JOIN labels -> four categorical fields
T2 generation   T1 x (3 models x 3 temperatures) -> status, latency, raw answer
T3 raw answers  the raw answer of T2, wrapped in one of eight ways
T4 multi-label  events -> per (user, day) set of event types
T5 vectors      embeddings -> neighbour pairs, argmax class
T6 prompts      conversations -> system text + ordered user turns
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.functions.sqltext import lit
from scoreplane.operators.pairs import FieldSpec
from scoreplane.sources.tables import code_fingerprint, materialize, plan_fingerprint

# ---------------------------------------------------------------- configuration
FIELDS = [
    FieldSpec("Language", "gt_language", ["EN", "DE", "ES", "FR", "PT", "NA"]),
    FieldSpec("Size Band", "gt_size_band", ["Short", "Medium", "Long", "Very Long", "NA"]),
    FieldSpec("Quality", "gt_quality", ["High", "Low", "NA"]),
    FieldSpec("Toxicity", "gt_toxicity", ["Clean", "Toxic", "NA"]),
]
MODELS = ["alpha-vl:7b", "beta-vl:13b", "gamma/vl-pro"]
TEMPERATURES = [0.0, 0.5, 1.0]
# Models whose records use the second generator schema (latency key renamed, usage map).
VARIANT_B_MODELS = ["gamma/vl-pro"]

Stage = Sequence[tuple[str, str]]


def _case(selector: str, values: Sequence[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {selector} {whens} END"


def _json_value(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'null' ELSE '\"' || {expr} || '\"' END"


# ---------------------------------------------------------------- T1 truth
TRUTH_STAGES: list[Stage] = [[
    ("item_id", "doc_id"),
    ("gt_language", "upper(lang)"),
    ("gt_size_band", "CASE WHEN n_chars < 1000 THEN 'Short' WHEN n_chars < 5000 THEN 'Medium' "
                     "WHEN n_chars < 20000 THEN 'Long' ELSE 'VERY LONG ' END"),
    ("gt_quality", "CASE quality WHEN 1 THEN 'High' WHEN 0 THEN 'low' END"),
    ("gt_toxicity", "CASE toxic WHEN 1 THEN ' Toxic' WHEN 0 THEN 'Clean' END"),
]]
TRUTH_COLUMNS = ["item_id", "gt_language", "gt_size_band", "gt_quality", "gt_toxicity"]


# ---------------------------------------------------------------- T2/T3 generation
def _pred_exprs() -> list[tuple[str, str]]:
    out = []
    for f_idx, f in enumerate(FIELDS):
        alts = [v for v in f.vocab if v != "NA"]
        r = f"((item_id * 7 + m * 3 + t * 5 + {f_idx * 11}) % 10)"
        alt = _case(f"((item_id + {r}) % {len(alts)})", alts)
        out.append((f"pv_{f_idx}",
                    f"CASE WHEN {r} < (2 + 2 * m) THEN "
                    f"(CASE WHEN {r} = 0 THEN 'Other' WHEN {r} = 1 THEN NULL ELSE {alt} END) "
                    f"WHEN {r} = 9 THEN '  ' || upper({f.gt_col}) || ' ' ELSE {f.gt_col} END"))
    return out


def _object_expr() -> str:
    parts = []
    for f_idx, f in enumerate(FIELDS):
        sep = "{" if f_idx == 0 else ", "
        parts.append(f"'{sep}\"{f.name}\": ' || {_json_value(f'pv_{f_idx}')}")
    parts.append("', \"Explanation\": \"item ' || CAST(item_id AS STRING) || '\"}'")
    return " || ".join(parts)


GENERATION_STAGES: list[Stage] = [
    [
        ("model", _case("m", MODELS)),
        ("temperature", "CAST(t AS DOUBLE) / 2"),
        ("s", "(item_id * 3 + m * 5 + t * 7) % 29"),
        ("w", "(item_id * 5 + m * 3 + t) % 32"),
    ],
    [
        ("dataset_idx", "CASE WHEN s = 4 THEN -1 WHEN s = 5 THEN NULL ELSE item_id END"),
        ("property_id", "item_id + 1"),
        ("status_api_call", "CASE WHEN s = 2 THEN NULL WHEN s = 0 THEN " + lit(K.CALL_FAILED) + " ELSE " + lit(K.CALL_OK) + " END"),
        ("latency_s", "CASE WHEN s = 2 THEN NULL ELSE "
                      "CAST((item_id * 37 + m * 101 + t * 53) % 5000 AS DOUBLE) / 1000 + 0.25 END"),
        ("n_images", "CASE WHEN s = 2 THEN 0 ELSE (item_id % 4) + 1 END"),
        *_pred_exprs(),
    ],
    [("obj", _object_expr())],
    [("raw_answer",
      "CASE WHEN s IN (0, 2) THEN NULL "
      "WHEN w = 0 THEN 'Answer:' || chr(10) || '```json' || chr(10) || obj || chr(10) || '```' || chr(10) || 'Note: {ignored}' "
      "WHEN w = 1 THEN 'Sure, here it is: ' || obj || ' Hope it helps.' "
      "WHEN w = 2 THEN obj || ' tail }' "
      "WHEN w = 3 THEN '{' || chr(1) || substr(obj, 2) "
      "WHEN w = 4 THEN replace(obj, chr(34), chr(39)) "
      "WHEN w = 5 THEN '' "
      "WHEN w = 6 THEN obj || ', ' || obj "
      "WHEN w = 7 THEN 'I cannot answer this.' "
      "ELSE obj END")],
]
GENERATION_COLUMNS = ["model", "temperature", "property_id", "dataset_idx", "status_api_call",
                      "latency_s", "n_images", "raw_answer"]


# ---------------------------------------------------------------- T4 multi-label
# capitalised, unsorted and repeated on purpose: operators normalise and sort it
MULTILABEL_VOCAB = ["View", " Click", "signup", "Purchase", "ERROR", "refund", "view "]

# ---------------------------------------------------------------- Spark side
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from scoreplane.sources.tables import read_table
    return read_table(spark, sf_dir, name)


def apply_stages(df: DataFrame, stages: Sequence[Stage], keep: Sequence[str] | None = None) -> DataFrame:
    for stage in stages:
        df = df.select("*", *[F.expr(expr).alias(name) for name, expr in stage])
    return df.select(*keep) if keep else df


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per document (only the columns the fields need are read)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return apply_stages(docs.join(labels, "doc_id", "left"), TRUTH_STAGES, TRUTH_COLUMNS)


def build_generation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2/T3 as a plan: one raw generation record per (model, temperature, item).

    The 3 x 3 grid is a literal array exploded in place (a Generate, no join)."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t"))
                               for m in range(len(MODELS)) for t in range(len(TEMPERATURES))]))
    base = truth(spark, sf_dir).select("*", grid.alias("g")).select("*", "g.m", "g.t").drop("g")
    return apply_stages(base, GENERATION_STAGES, GENERATION_COLUMNS)


PARSED_COLUMNS = ["parsed", "json_parsing_error_msg", "status_json_parsing", "status_geracao"]


def generation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2/T3 as stored generation output: written once for the given input files,
    partitioned by run, with the raw answer *and* its parse (map, error, status),
    as the generation stage stores them (I2 -> K1).

    Generation output is a stored table in practice (model calls must never be
    recomputed); reading it back also keeps the generator's expressions out of
    every later plan.  Evaluation reads the stored parse; the JSON queries parse
    the stored raw text again."""
    from scoreplane.operators.generate import parse_answers

    parsed = parse_answers(build_generation_records(spark, sf_dir)).hint("rebalance", "model", "temperature")
    df = materialize(parsed, "generation", partition_by=("model", "temperature"), max_records_per_file=2_000_000)
    return df.select(*GENERATION_COLUMNS, *PARSED_COLUMNS)


# ---------------------------------------------------------------- DuckDB side
def sql_stages(source_sql: str, stages: Sequence[Stage], keep: Sequence[str] | None = None) -> str:
    sql = source_sql
    for stage in stages:
        cols = ", ".join(f"{expr} AS {name}" for name, expr in stage)
        sql = f"SELECT *, {cols} FROM ({sql})"
    if keep:
        sql = f"SELECT {', '.join(keep)} FROM ({sql})"
    return sql


TRUTH_SQL = sql_stages(
    "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    TRUTH_STAGES, TRUTH_COLUMNS)

_GRID_SQL = ("SELECT * FROM (" + TRUTH_SQL + ") CROSS JOIN (SELECT m, t FROM range(0, "
             f"{len(MODELS)}) r1(m) CROSS JOIN range(0, {len(TEMPERATURES)}) r2(t))")
GENERATION_SQL = sql_stages(_GRID_SQL, GENERATION_STAGES, GENERATION_COLUMNS)


def cached_generation(name: str, requests: DataFrame, generate, run) -> DataFrame:
    """Run ``run(requests, generate)`` once and keep its output as a table (calls are never
    repeated by a later recomputation); other requests, input files or code, called helpers and closed-over values included,
    make another table."""
    told = [plan_fingerprint(requests), code_fingerprint(generate), code_fingerprint(run)]
    return materialize(run(requests, generate), f"generated-{name}", key=None if None in told else "\n".join(told))
