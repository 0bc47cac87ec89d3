"""DuckDB SQL stating the expected result of every registered query.

Written independently of the Spark plans: the SQL spells out the semantics
(canonical labels, strict JSON, two label universes, zero-fill, zero division)
with DuckDB's own functions, over the same adapter inputs."""

from __future__ import annotations

from scoreplane import constants as K
from scoreplane.plans import adapters as A

ORACLE: dict[str, str] = {}

WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}', ' ', 'g'))"


def canon(x: str) -> str:
    return f"coalesce(nullif({norm(f'CAST({x} AS VARCHAR)')}, ''), 'na')"


def _lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PLACEHOLDERS = _lit_list(K.VOCAB_PLACEHOLDERS)
DIM_SQL = " UNION ALL ".join(
    f"SELECT '{f.name}' AS field, '{f.gt_col}' AS gt_col, "
    f"list_sort(list_distinct(list_concat(list_transform({_lit_list(f.vocab)}, lambda x: lower(trim(x))), {PLACEHOLDERS}))) AS vocab"
    for f in A.FIELDS)

CAND = ("coalesce(nullif(regexp_extract(raw_answer, '```json\\s*(\\{[\\s\\S]*?\\})\\s*```', 1), ''), "
        "nullif(regexp_extract(raw_answer, '(?s)\\{.*\\}', 0), ''))")
PARSED_SQL = f"""
SELECT *,
  CASE WHEN status_api_call IS NULL THEN '{K.STATUS_DIR_MISSING}'
       WHEN status_api_call <> 'sucesso' THEN '{K.STATUS_API_ERROR}'
       WHEN NOT ok THEN '{K.STATUS_PARSE_ERROR}' ELSE '{K.STATUS_OK}' END AS status_geracao,
  CASE WHEN ok THEN 'sucesso' ELSE 'falha' END AS status_json_parsing
FROM (
  SELECT *, coalesce(CASE WHEN json_valid(cleaned) THEN json_type(cleaned::JSON) = 'OBJECT'
                               AND len(json_keys(cleaned::JSON)) > 0 END, false) AS ok
  FROM (SELECT *, regexp_replace({CAND}, '[\\x{{00}}-\\x{{07}}\\x{{0b}}\\x{{0e}}-\\x{{1f}}\\x{{7f}}]', '', 'g') AS cleaned
        FROM ({A.GENERATION_SQL})))
"""


def _pairs_sql(compat: bool = True) -> str:
    parts = []
    for f in A.FIELDS:
        pred = f"CASE WHEN g.ok THEN json_extract_string(g.cleaned::JSON, '$.\"{f.name}\"') END"
        skipped = "t.item_id IS NULL"
        failed = ("(g.status_geracao = 'erro_diretorio_nao_encontrado' OR coalesce(g.status_api_call = 'falha', false) "
                  "OR NOT g.ok)")
        parts.append(
            f"SELECT g.model, g.temperature, g.dataset_idx, '{f.name}' AS field, "
            f"CASE WHEN {skipped} THEN 'na_item_pulado' ELSE {canon('t.' + f.gt_col)} END AS y_true, "
            f"CASE WHEN {skipped} THEN 'na_item_pulado' WHEN {failed} THEN 'na_falha_geracao_ou_parse' "
            f"ELSE {canon(pred)} END AS y_pred, {failed} AS is_failure, {skipped} AS is_skipped "
            f"FROM parsed g LEFT JOIN truth t ON g.dataset_idx = t.item_id")
    sql = " UNION ALL ".join(parts)
    return sql if compat else f"SELECT * FROM ({sql}) WHERE NOT is_skipped"


BASE_CTES = f"""
truth AS ({A.TRUTH_SQL}),
gen AS ({A.GENERATION_SQL}),
parsed AS ({PARSED_SQL}),
dim AS ({DIM_SQL}),
pairs AS ({_pairs_sql()}),
counts AS (SELECT model, temperature, field, y_true, y_pred, count(*) AS n FROM pairs GROUP BY ALL),
grid AS (SELECT c.model, c.temperature, c.field, unnest(d.vocab) AS label
         FROM (SELECT DISTINCT model, temperature, field FROM counts) c JOIN dim d USING (field)),
tside AS (SELECT model, temperature, field, y_true AS label, CAST(sum(n) AS BIGINT) AS support_true,
                 CAST(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS BIGINT) AS tp
          FROM counts GROUP BY ALL),
pside AS (SELECT model, temperature, field, y_pred AS label, CAST(sum(n) AS BIGINT) AS support_pred
          FROM counts GROUP BY ALL),
pc AS (SELECT g.model, g.temperature, g.field, g.label,
              coalesce(t.support_true, 0) AS support_true, coalesce(p.support_pred, 0) AS support_pred,
              coalesce(t.tp, 0) AS tp
       FROM grid g LEFT JOIN tside t USING (model, temperature, field, label)
                   LEFT JOIN pside p USING (model, temperature, field, label)),
pcs AS (SELECT *, CASE WHEN support_pred > 0 THEN tp / support_pred ELSE 0.0 END AS precision,
               CASE WHEN support_true > 0 THEN tp / support_true ELSE 0.0 END AS recall,
               CASE WHEN support_pred + support_true > 0 THEN 2 * tp / (support_pred + support_true) ELSE 0.0 END AS f1
        FROM pc),
acc AS (SELECT model, temperature, field,
               sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n) AS accuracy,
               CAST(sum(n) AS BIGINT) AS n_items
        FROM counts GROUP BY ALL),
oovp AS (SELECT c.model, c.temperature, c.field, CAST(sum(c.n) AS BIGINT) AS n_oov_pred
         FROM counts c JOIN dim d USING (field) WHERE NOT list_contains(d.vocab, c.y_pred) GROUP BY ALL),
wsum AS (SELECT model, temperature, field, sum(support_true) AS w,
                sum(precision * support_true) AS sp, sum(recall * support_true) AS sr, sum(f1 * support_true) AS sf
         FROM pcs GROUP BY ALL),
summ AS (SELECT a.model, a.temperature, a.field, a.accuracy,
                CASE WHEN w > 0 THEN sp / w ELSE 0.0 END AS precision_weighted,
                CASE WHEN w > 0 THEN sr / w ELSE 0.0 END AS recall_weighted,
                CASE WHEN w > 0 THEN sf / w ELSE 0.0 END AS f1_score_weighted,
                a.n_items, coalesce(o.n_oov_pred, 0) AS n_oov_pred
         FROM acc a JOIN wsum USING (model, temperature, field)
                    LEFT JOIN oovp o USING (model, temperature, field))
"""


def with_base(select: str) -> str:
    return f"WITH {BASE_CTES} {select}"


def oracle(name: str, select: str, base: bool = True) -> None:
    ORACLE[name] = with_base(select) if base else select


M4 = "round(accuracy, 6) AS accuracy, round(f1_score_weighted, 6) AS f1_score_weighted, " \
     "round(precision_weighted, 6) AS precision_weighted, round(recall_weighted, 6) AS recall_weighted"

oracle("confusion_counts", "SELECT * FROM counts")
oracle("field_accuracy", "SELECT model, temperature, field, round(accuracy, 6) AS accuracy, n_items FROM summ")
oracle("per_class_metrics",
       "SELECT model, temperature, field, label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round(f1, 6) AS f1, support_true, support_pred, tp FROM pcs")
oracle("weighted_metrics",
       "SELECT model, temperature, field, round(accuracy, 6) AS accuracy, "
       "round(precision_weighted, 6) AS precision_weighted, round(recall_weighted, 6) AS recall_weighted, "
       "round(f1_score_weighted, 6) AS f1_score_weighted, n_items, n_oov_pred FROM summ")
oracle("macro_average",
       "SELECT model, temperature, round(avg(accuracy), 6) AS accuracy, round(avg(f1_score_weighted), 6) AS f1_score_weighted, "
       "round(avg(precision_weighted), 6) AS precision_weighted, round(avg(recall_weighted), 6) AS recall_weighted, "
       "count(*) AS n_categories FROM summ GROUP BY ALL")
oracle("summary_with_overall",
       f"SELECT model, temperature, field AS category, {M4}, false AS is_overall FROM summ UNION ALL "
       f"SELECT model, temperature, '{K.OVERALL_CATEGORY}' AS category, round(avg(accuracy), 6) AS accuracy, "
       "round(avg(f1_score_weighted), 6) AS f1_score_weighted, round(avg(precision_weighted), 6) AS precision_weighted, "
       "round(avg(recall_weighted), 6) AS recall_weighted, true AS is_overall FROM summ GROUP BY model, temperature")

_LANG = ["de", "en", "es", "fr", "na", "na_falha_geracao_ou_parse", "na_item_invalido_ou_pulado", "pt"]
oracle("confusion_matrix_pivot",
       "SELECT g.model, g.temperature, 'Language' AS field, g.label AS y_true, "
       + ", ".join(f"CAST(coalesce(sum(CASE WHEN c.y_pred = '{l}' THEN c.n END), 0) AS BIGINT) AS \"{l}\"" for l in _LANG)
       + " FROM grid g LEFT JOIN counts c ON c.model = g.model AND c.temperature = g.temperature "
         "AND c.field = g.field AND c.y_true = g.label AND c.y_pred IN (" + ", ".join(f"'{l}'" for l in _LANG) + ") "
         "WHERE g.field = 'Language' GROUP BY g.model, g.temperature, g.label")
oracle("per_class_map",
       "SELECT p.model, p.temperature, p.field, g.labels_used, g.n_labels, p.label, round(p.precision, 6) AS precision, "
       "round(p.recall, 6) AS recall, round(p.f1, 6) AS f1_score, CAST(p.support_true AS BIGINT) AS support_ground_truth, "
       "CAST(p.support_pred AS BIGINT) AS support_predicted FROM pcs p JOIN ("
       "SELECT model, temperature, field, string_agg(label, '|' ORDER BY label) AS labels_used, "
       "CAST(count(*) AS INTEGER) AS n_labels FROM pcs GROUP BY ALL) g USING (model, temperature, field)")
oracle("observed_labels",
       "SELECT field, y_true AS label FROM counts UNION SELECT field, y_pred AS label FROM counts")
oracle("vocab_with_placeholders",
       "SELECT v.field, v.label, CAST(v.position AS INTEGER) AS position, "
       "CAST(coalesce(s.support_true, 0) AS BIGINT) AS support_true "
       "FROM (SELECT field, unnest(vocab) AS label, generate_subscripts(vocab, 1) - 1 AS position FROM dim) v "
       "LEFT JOIN (SELECT field, y_true AS label, sum(n) AS support_true FROM counts GROUP BY ALL) s "
       "USING (field, label)")
oracle("oov_rate",
       "SELECT p.model, p.temperature, p.field, count(*) FILTER (WHERE NOT list_contains(d.vocab, p.y_pred)) AS n_oov, "
       "round(avg(CASE WHEN list_contains(d.vocab, p.y_pred) THEN 0.0 ELSE 1.0 END), 6) AS oov_rate "
       "FROM pairs p JOIN dim d USING (field) GROUP BY ALL")
oracle("oov_values",
       "SELECT c.field, c.y_pred, CAST(sum(c.n) AS BIGINT) AS n FROM counts c JOIN dim d USING (field) "
       "WHERE NOT list_contains(d.vocab, c.y_pred) GROUP BY ALL")
oracle("failure_masked_pairs",
       "SELECT model, temperature, dataset_idx, field, y_true, y_pred FROM pairs WHERE is_failure AND NOT is_skipped")
oracle("skipped_items",
       "SELECT model, temperature, count(*) AS n_skipped FROM gen g "
       "WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.item_id = g.dataset_idx) GROUP BY ALL")
oracle("status_breakdown",
       "SELECT model, temperature, status_geracao, count(*) AS n, CAST(sum(n_images) AS BIGINT) AS n_images, "
       "count(*) FILTER (WHERE status_json_parsing = 'sucesso') AS n_parsed FROM parsed GROUP BY ALL")
oracle("unpivot_fields",
       "SELECT item_id, field, y_true FROM (" + " UNION ALL ".join(
           f"SELECT item_id, '{f.name}' AS field, CAST({f.gt_col} AS VARCHAR) AS y_true FROM truth" for f in A.FIELDS)
       + ")")


# ====================================================================== batch 2
def _ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


RUNS = "runs AS (SELECT DISTINCT model, temperature FROM gen)"
GEN = f"truth AS ({A.TRUTH_SQL}), gen AS ({A.GENERATION_SQL})"
FILE_NAME = ("'evaluation_metrics_' || translate(model, ':/', '__') || '_temp_' || "
             "replace(CAST(temperature AS VARCHAR), '.', 'p') || '.json'")
NAME_RE = r"evaluation_metrics_(.+?)_temp_([\d_p]+)\.json"


def model_from_name(x: str) -> str:
    return (f"regexp_replace(translate(nullif(regexp_extract({x}, '{NAME_RE}', 1), ''), '_', ':'), "
            r"'^(.+?):\d{8}:\d{6}.*$', '\1')")


def escape(x: str, model: bool = False) -> str:
    out = f"CAST({x} AS VARCHAR)"
    if model:
        out = f"replace({out}, '_', ':')"
    for old, new in K.TEXT_ESCAPES:
        out = f"replace({out}, '{old}', '{new}')"
    return out


oracle("canonical_labels", _ctes(GEN, f"parsed AS ({PARSED_SQL})") + "SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f.name}' AS field, json_extract_string(cleaned::JSON, '$.\"{f.name}\"') AS raw_value, "
    f"{canon(chr(34) + 'raw' + chr(34))} AS label FROM (SELECT cleaned, json_extract_string(cleaned::JSON, "
    f"'$.\"{f.name}\"') AS raw FROM parsed WHERE ok)" for f in A.FIELDS) + ")", base=False)
oracle("normalized_text", f"SELECT doc_id, {norm('text')} AS text_norm FROM documents", base=False)
oracle("slugs", "SELECT p_partkey, translate(concat_ws(' ', p_type, p_name), ' çãáé', '_caae') AS slug FROM part",
       base=False)
oracle("safe_names", _ctes(GEN, RUNS) +
       "SELECT model, temperature, translate(model, ':/', '__') AS model_safe, "
       f"replace(CAST(temperature AS VARCHAR), '.', 'p') AS temp_safe, {FILE_NAME} AS file_name FROM runs", base=False)
oracle("filename_parse", _ctes(GEN, RUNS, f"names AS (SELECT {FILE_NAME} AS file_name FROM runs UNION ALL "
                                          f"SELECT replace({FILE_NAME}, '.json', '_20250619_130001.json') FROM runs)") +
       f"SELECT file_name, {model_from_name('file_name')} AS model_from_name, "
       f"regexp_replace(translate(nullif(regexp_extract(file_name, '{NAME_RE}', 2), ''), 'p', '.'), "
       r"'_\d{8}_\d{6}$', '') AS temperature_from_name FROM names", base=False)
oracle("metadata_fallback", _ctes(GEN, "runs AS (SELECT model, temperature, sum(latency_s) AS total_s FROM gen GROUP BY ALL)") +
       "SELECT model, temperature, coalesce(CASE WHEN temperature <> 0.5 THEN model END, "
       f"CASE WHEN temperature <> 1.0 THEN {model_from_name(FILE_NAME)} END, '{K.UNKNOWN_MODEL}') AS model_resolved, "
       "round(coalesce(nullif(CASE WHEN temperature = 0.0 THEN 0.0 ELSE total_s + 1 END, 0), total_s), 6) AS run_time_s "
       "FROM runs", base=False)
oracle("coerce_temperature", _ctes(GEN, RUNS) +
       "SELECT model, temperature, label, TRY_CAST(label AS DOUBLE) AS temperature_num FROM "
       f"(SELECT *, CASE WHEN temperature = 1.0 THEN '{K.TEMPERATURE_UNKNOWN}' ELSE CAST(temperature AS VARCHAR) END AS label FROM runs)",
       base=False)
oracle("fixed_format", "SELECT model, temperature, field, printf('%.2f', round(accuracy, 9)) AS accuracy_2, "
       "printf('%.4f', round(f1_score_weighted, 9)) AS f1_4, printf('%.2f', round(n_items / 8, 9)) AS eighths_2 FROM summ")
oracle("escaped_labels", f"SELECT page_id, {escape('url')} AS escaped, "
       f"{escape(chr(39) + '~^{}' + chr(92) + '_$' + chr(39) + ' || url', True)} AS escaped_model FROM pages", base=False)

_GENP = _ctes(GEN, f"parsed AS ({PARSED_SQL})")
oracle("json_candidate", _GENP + f"SELECT model, temperature, property_id, {CAND} AS candidate FROM gen", base=False)
oracle("json_clean", _GENP + "SELECT model, temperature, property_id, cleaned FROM parsed", base=False)
oracle("json_strict_parse", _GENP +
       "SELECT model, temperature, property_id, CASE WHEN raw_answer IS NULL OR raw_answer = '' THEN 'empty' "
       f"WHEN {CAND} IS NULL THEN 'no_json' WHEN NOT ok THEN 'invalid' ELSE 'ok' END AS outcome, "
       "CASE WHEN ok THEN CAST(len(json_keys(cleaned::JSON)) AS INTEGER) END AS n_members FROM parsed", base=False)
oracle("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, "
       "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num FROM events", base=False)
oracle("latency_stats", _ctes(GEN) + "SELECT model, temperature, count(latency_s) AS n_timed, "
       "round(sum(latency_s), 6) AS total_s, round(avg(latency_s), 6) AS mean_s, round(min(latency_s), 6) AS min_s, "
       "round(max(latency_s), 6) AS max_s FROM gen GROUP BY ALL", base=False)
oracle("iso_stamps", "SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS first_iso, "
       "strftime(max(ts), '%Y%m%d_%H%M%S') AS last_stamp, "
       "round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS active_s FROM events GROUP BY user_id", base=False)

BASENAME = "string_split(url, '/')[-1]"
EXT = f"lower(regexp_extract({BASENAME}, '\\.([^./]+)$', 1))"
MIME = (f"CASE {EXT} " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in K.IMAGE_MIME.items())
        + f" ELSE '{K.DEFAULT_IMAGE_MIME}' END")
DATA_URL = f"'data:' || {MIME} || ';base64,' || to_base64(encode(html))"


def suspicious(x: str) -> str:
    starts = " OR ".join(f"starts_with({x}, '{p}')" for p in K.BASE64_MAGIC_PREFIXES)
    return f"coalesce(length({x}) > {K.BASE64_MIN_LENGTH} AND ({starts}), false)"


oracle("base64_data_url", f"SELECT page_id, {MIME} AS mime, {DATA_URL} AS data_url FROM pages", base=False)
oracle("suspicious_paths",
       "SELECT page_id, kind, " + suspicious("value") + " AS suspicious FROM ("
       "SELECT page_id, 'url' AS kind, url AS value FROM pages UNION ALL "
       f"SELECT page_id, 'data_url', {DATA_URL} FROM pages UNION ALL "
       "SELECT page_id, 'base64', to_base64(encode(html)) FROM pages)", base=False)
oracle("path_basename", f"SELECT page_id, {BASENAME} AS basename, {EXT} AS extension, "
       f"{EXT} IN ({', '.join(repr(e) for e in K.IMAGE_EXTENSIONS)}) AS is_image FROM pages", base=False)

ML_LABELS = ["click", "error", "purchase", "refund", "signup", "view"]  # what the vocabulary of the queries must come to
ML_ITEMS = ("days AS (SELECT user_id, CAST(ts AS DATE) AS day, list_distinct(list(lower(trim(event_type)))) AS y_true "
            "FROM events GROUP BY ALL), "
            "items AS (SELECT user_id, day, y_true, coalesce(lag(y_true) OVER (PARTITION BY user_id ORDER BY day), "
            "CAST([] AS VARCHAR[])) AS y_pred FROM days), "
            f"vocab AS (SELECT unnest({_lit_list(ML_LABELS)}) AS label), "
            "flags AS (SELECT i.user_id, i.day, v.label, CASE WHEN list_contains(i.y_true, v.label) THEN 1 ELSE 0 END AS t, "
            "CASE WHEN list_contains(i.y_pred, v.label) THEN 1 ELSE 0 END AS p FROM items i CROSS JOIN vocab v), "
            "perl AS (SELECT label, sum(t * p) AS tp, sum(t) AS st, sum(p) AS sp, count(*) AS n FROM flags GROUP BY label), "
            "perls AS (SELECT *, CASE WHEN sp > 0 THEN tp / sp ELSE 0.0 END AS precision, "
            "CASE WHEN st > 0 THEN tp / st ELSE 0.0 END AS recall, "
            "CASE WHEN sp + st > 0 THEN 2 * tp / (sp + st) ELSE 0.0 END AS f1 FROM perl)")


def _hot_sql(col: str) -> str:
    return " || ".join(f"CASE WHEN list_contains({col}, '{v}') THEN '1' ELSE '0' END" for v in ML_LABELS)


oracle("multihot", "WITH " + ML_ITEMS + f" SELECT user_id, day, {_hot_sql('y_true')} AS true_hot, "
       f"{_hot_sql('y_pred')} AS pred_hot FROM items", base=False)
oracle("multilabel_micro", "WITH " + ML_ITEMS +
       " SELECT round(sum(tp) / sum(sp), 6) AS precision_micro, round(sum(tp) / sum(st), 6) AS recall_micro, "
       "round(2 * sum(tp) / (sum(sp) + sum(st)), 6) AS f1_score_micro, (SELECT count(*) FROM items) AS n_items FROM perl",
       base=False)
oracle("multilabel_macro", "WITH " + ML_ITEMS +
       " SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, "
       "round(avg(f1), 6) AS f1_score_macro FROM perls", base=False)
VOC = _lit_list(ML_LABELS)
oracle("subset_accuracy", "WITH " + ML_ITEMS +
       f" SELECT round(avg(CASE WHEN list_sort(list_intersect(y_true, {VOC})) = list_sort(list_intersect(y_pred, {VOC})) "
       "THEN 1.0 ELSE 0.0 END), 6) AS accuracy_subset, count(*) AS n_items FROM items", base=False)
oracle("label_2x2", "WITH " + ML_ITEMS +
       " SELECT label, CAST(n - sp - st + tp AS BIGINT) AS tn, CAST(sp - tp AS BIGINT) AS fp, CAST(st - tp AS BIGINT) AS fn, "
       "CAST(tp AS BIGINT) AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 "
       "FROM perls", base=False)
oracle("multilabel_empty", "SELECT 1.0 AS precision_micro, 1.0 AS recall_micro, 1.0 AS f1_score_micro, 1.0 AS precision_macro, "
       "1.0 AS recall_macro, 1.0 AS f1_score_macro, 1.0 AS accuracy_subset, count(*) AS n_items, "
       "'Todas as listas de benfeitorias estavam vazias ou resultaram em vetores vazios.' AS note "
       "FROM events WHERE event_type = 'no such type'", base=False)
oracle("multilabel_by_user_activity", "WITH " + ML_ITEMS +
       ", band AS (SELECT user_id, CASE WHEN count(*) >= 25 THEN 'high' ELSE 'low' END AS band FROM items GROUP BY user_id), "
       "bl AS (SELECT b.band, f.label, sum(t * p) AS tp, sum(t) AS st, sum(p) AS sp FROM flags f JOIN band b USING (user_id) "
       "GROUP BY ALL), "
       "bls AS (SELECT *, CASE WHEN sp > 0 THEN tp / sp ELSE 0.0 END AS pr, CASE WHEN st > 0 THEN tp / st ELSE 0.0 END AS rc, "
       "CASE WHEN sp + st > 0 THEN 2 * tp / (sp + st) ELSE 0.0 END AS f1 FROM bl) "
       "SELECT band, round(CASE WHEN sum(sp) > 0 THEN sum(tp) / sum(sp) ELSE 0.0 END, 6) AS precision_micro, "
       "round(CASE WHEN sum(st) > 0 THEN sum(tp) / sum(st) ELSE 0.0 END, 6) AS recall_micro, "
       "round(CASE WHEN sum(sp) + sum(st) > 0 THEN 2 * sum(tp) / (sum(sp) + sum(st)) ELSE 0.0 END, 6) AS f1_score_micro, "
       "round(avg(pr), 6) AS precision_macro, round(avg(rc), 6) AS recall_macro, round(avg(f1), 6) AS f1_score_macro "
       "FROM bls GROUP BY band", base=False)

oracle("cosine_pairs",
       "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(CASE WHEN len(a.embedding) > 0 AND len(b.embedding) > 0 "
       "AND sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * "
       "sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) > 0 "
       "THEN list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / "
       "(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * "
       "sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) END, 6) AS cosine "
       "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", base=False)

oracle("vector_class_metrics", """WITH
scored AS (SELECT label, list_transform(range(10), lambda c: coalesce(list_sum(list_filter(embedding::DOUBLE[], lambda x, i: (i - 1) % 10 = c)), 0))
           AS s FROM embeddings),
preds AS (SELECT label, list_position(s, list_max(s)) - 1 AS c FROM scored),
prs AS (SELECT 'class' AS field, label::VARCHAR AS y_true, c::VARCHAR AS y_pred FROM preds UNION ALL
        SELECT 'half', CASE WHEN label < 5 THEN 'low' ELSE 'high' END, CASE WHEN c < 5 THEN 'low' ELSE 'high' END FROM preds),
voc AS (SELECT 'class' AS field, unnest(range(10))::VARCHAR AS label UNION ALL SELECT 'half', unnest(['low', 'high'])),
pc AS (SELECT v.field, v.label, count(*) FILTER (y_true = v.label) AS st, count(*) FILTER (y_pred = v.label) AS sp,
              count(*) FILTER (y_true = v.label AND y_pred = v.label) AS tp
       FROM voc v JOIN prs p ON v.field = p.field GROUP BY ALL),
pcs AS (SELECT *, CASE WHEN sp > 0 THEN tp / sp ELSE 0.0 END AS pr, CASE WHEN st > 0 THEN tp / st ELSE 0.0 END AS rc,
        CASE WHEN sp + st > 0 THEN 2 * tp / (sp + st) ELSE 0.0 END AS f1 FROM pc),
acc AS (SELECT field, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_items FROM prs GROUP BY field)
SELECT 'class-sums' AS model, a.field, round(any_value(accuracy), 6) AS accuracy,
  round(CASE WHEN sum(st) > 0 THEN sum(pr * st) / sum(st) ELSE 0.0 END, 6) AS precision_weighted,
  round(CASE WHEN sum(st) > 0 THEN sum(rc * st) / sum(st) ELSE 0.0 END, 6) AS recall_weighted,
  round(CASE WHEN sum(st) > 0 THEN sum(f1 * st) / sum(st) ELSE 0.0 END, 6) AS f1_score_weighted, any_value(n_items) AS n_items
FROM acc a JOIN pcs USING (field) GROUP BY a.field""", base=False)

_MODELS_SQL = " UNION ALL ".join(f"SELECT '{m}' AS model, {i} AS m" for i, m in enumerate(A.MODELS))
_TEMPS_SQL = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS temperature" for t in A.TEMPERATURES)
oracle("experiment_grid", _ctes(f"truth AS ({A.TRUTH_SQL})") +
       f"SELECT g.model, t.temperature, count(*) AS n_items, min(item_id) AS min_item, max(item_id) AS max_item "
       f"FROM truth CROSS JOIN ({_MODELS_SQL}) g CROSS JOIN ({_TEMPS_SQL}) t GROUP BY ALL", base=False)
_REQ = " UNION ALL ".join(f"SELECT '{m}' AS model" for m in [*A.MODELS, "delta-vl:70b"])
oracle("available_models", _ctes(GEN) +
       f"SELECT model, model IN (SELECT model FROM gen WHERE status_api_call = 'sucesso') AS available FROM ({_REQ})",
       base=False)
DIRS = ("dirs AS (SELECT dir_name FROM (SELECT unnest([CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END, "
        "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) || '_' || lower(translate(c_name, '#', '_')) END, "
        "CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) || '_b' END, "
        "CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) || '1_x' END]) AS dir_name FROM customer) "
        "WHERE dir_name IS NOT NULL)")
oracle("entity_directory_match", "WITH " + DIRS + ", ent AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer), "
       "m AS (SELECT e.entity_id, d.dir_name, CASE WHEN d.dir_name = e.entity_id THEN 0 ELSE 1 END AS pri FROM ent e "
       "JOIN dirs d ON d.dir_name = e.entity_id OR starts_with(d.dir_name, e.entity_id || '_')), "
       "best AS (SELECT entity_id, arg_min(dir_name, (pri, dir_name)) AS dir, min(pri) AS pri FROM m GROUP BY entity_id) "
       "SELECT e.entity_id, b.dir, CASE b.pri WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'none' END AS match_kind "
       "FROM ent e LEFT JOIN best b USING (entity_id)", base=False)
PROMPTS = ("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS system, "
           "coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS prompt, "
           "CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS n_parts FROM conversations GROUP BY conv_id")
oracle("request_assembly", PROMPTS, base=False)
RESP = ("CASE WHEN prompt = '' THEN NULL ELSE 'Result:' || chr(10) || '```json' || chr(10) || '{\"n_chars\": ' || "
        "CAST(length(prompt) AS VARCHAR) || ', \"n_images\": 0}' || chr(10) || '```' END")
_RUNS = ("(SELECT unnest([" + ", ".join(f"'{m}'" for m in A.MODELS) + "]) AS model) g CROSS JOIN (SELECT unnest(["
         + ", ".join(f"{t}::DOUBLE" for t in A.TEMPERATURES) + "]) AS temperature) t")
oracle("batch_generate", f"SELECT conv_id AS request_id, model, temperature, CASE WHEN prompt = '' THEN '{K.CALL_FAILED}' "
       f"ELSE '{K.CALL_OK}' END AS status_api_call, {RESP} AS raw_answer FROM ({PROMPTS}) p CROSS JOIN {_RUNS}", base=False)
_ITEMS = (f"SELECT p.*, p.conv_id % 7 <> 3 AS found, CASE WHEN p.conv_id % 7 <> 3 AND p.conv_id % 5 <> 4 AND "
          f"p.conv_id IN (SELECT page_id FROM pages) THEN 1 + CASE WHEN p.conv_id % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS n_images "
          f"FROM ({PROMPTS}) p")
_GRID2 = (f"SELECT p.*, g.model, t.temperature, found AND n_images > 0 AND prompt <> '' AS ok FROM ({_ITEMS}) p "
          f"CROSS JOIN {_RUNS}")
_NO_DIR = "'Diretório para ''' || conv_id::VARCHAR || ''' não encontrado.'"
_MESSAGE = (f"CASE WHEN NOT found THEN {_NO_DIR} "
            "WHEN n_images = 0 THEN 'Nenhuma imagem codificada para API.' WHEN prompt = '' THEN 'empty prompt' END")
oracle("grid_generation", "SELECT conv_id AS request_id, model, temperature, CASE WHEN NOT found THEN 'erro_diretorio_nao_encontrado' "
       "WHEN NOT ok THEN 'erro_api' ELSE 'processado_com_sucesso' END AS status_geracao, "
       "CASE WHEN ok THEN CAST(length(prompt) AS BIGINT) END AS n_chars, CAST(n_images AS INTEGER) AS n_images, "
       "CASE WHEN ok THEN CAST(n_images AS BIGINT) END AS n_images_seen, "
       f"{_MESSAGE} AS error_message FROM ({_GRID2})", base=False)
RESP2 = RESP.replace("\"n_images\": 0}'", "\"n_images\": ' || CAST(n_images AS VARCHAR) || '}'")
oracle("usage_totals", "SELECT model, CAST(sum(CASE WHEN ok THEN length(prompt) END) AS BIGINT) AS prompt_chars, "
       f"CAST(sum(CASE WHEN ok THEN length({RESP2}) END) AS BIGINT) AS response_chars, count(*) AS n_calls FROM ({_GRID2}) "
       "GROUP BY model", base=False)

oracle("first_n", _ctes(f"truth AS ({A.TRUTH_SQL})") + "SELECT * FROM truth ORDER BY item_id LIMIT 10", base=False)
oracle("first_valid", _GENP + f"SELECT model, temperature, min(dataset_idx) AS first_valid_idx FROM parsed "
       f"WHERE status_geracao = '{K.STATUS_OK}' AND dataset_idx IN (SELECT item_id FROM truth) GROUP BY ALL", base=False)
_FIVE = f"WITH five AS (SELECT * FROM ({_ITEMS}) ORDER BY conv_id LIMIT 5) "
oracle("preflight_checks", _FIVE + "SELECT conv_id AS request_id, 'directory_found' AS check, found AS ok, "
       f"CASE WHEN NOT found THEN {_NO_DIR} END AS detail FROM five "
       "UNION ALL SELECT conv_id, 'images_found', n_images > 0, n_images::VARCHAR FROM five "
       "UNION ALL SELECT conv_id, 'item_processed', prompt <> '', CASE WHEN prompt = '' THEN 'erro_api' ELSE "
       "'processado_com_sucesso' END FROM (SELECT * FROM five WHERE n_images > 0 ORDER BY conv_id LIMIT 1)", base=False)

REP = ("rep AS (SELECT replace(model, ':', '_') AS Modelo, CAST(temperature AS VARCHAR) AS Temperatura, field AS Categoria, "
       "translate(field, ' çãáé', '_caae') AS category_key, accuracy AS \"Accuracy\", f1_score_weighted AS \"F1-Score\", "
       "precision_weighted AS \"Precision\", recall_weighted AS \"Recall\" FROM summ)")
OVER = ("ovr AS (SELECT replace(s.model, ':', '_') AS Modelo, CAST(s.temperature AS VARCHAR) AS Temperatura, "
        "avg(accuracy) AS \"Accuracy\", avg(f1_score_weighted) AS \"F1-Score\", avg(precision_weighted) AS \"Precision\", "
        "avg(recall_weighted) AS \"Recall\", any_value(l.total_s) AS \"Tempo de Execucao Total (s)\" FROM summ s "
        "JOIN (SELECT model, temperature, sum(latency_s) AS total_s FROM gen GROUP BY ALL) l USING (model, temperature) "
        "GROUP BY s.model, s.temperature)")
R4 = ('round("Accuracy", 6) AS "Accuracy", round("F1-Score", 6) AS "F1-Score", round("Precision", 6) AS "Precision", '
      'round("Recall", 6) AS "Recall"')


def with_rep(select: str) -> str:
    return f"WITH {BASE_CTES}, {REP}, {OVER} {select}"


ORACLE["flatten_reports"] = with_rep(f"SELECT Modelo, Temperatura, Categoria, {R4} FROM rep")
ORACLE["display_category"] = with_rep("SELECT DISTINCT category_key, Categoria FROM rep")
ORACLE["overall_rows"] = with_rep(f'SELECT Modelo, Temperatura, {R4}, round("Tempo de Execucao Total (s)", 6) '
                                  'AS "Tempo de Execucao Total (s)" FROM ovr')
ORACLE["metrics_long"] = with_rep(
    "SELECT Modelo, Temperatura, Categoria, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(
        f"SELECT Modelo, Temperatura, Categoria, '{m}' AS metric, \"{m}\" AS value FROM rep"
        for m in ["Accuracy", "F1-Score", "Precision", "Recall"]) + ") WHERE value IS NOT NULL")
_ORD = "Categoria, TRY_CAST(Temperatura AS DOUBLE) NULLS LAST, Temperatura"
_CELLS = " || ' & ' || ".join([
    "CASE WHEN rn_g = 1 THEN '\\multirow{' || n_g || '}{*}{\\textbf{' || " + escape("Modelo", True) + " || '}}' ELSE '' END",
    "CASE WHEN rn_s = 1 THEN '\\multirow{' || n_s || '}{*}{' || " + escape("Categoria") + " || '}' ELSE '' END",
    "CASE WHEN TRY_CAST(Temperatura AS DOUBLE) IS NOT NULL THEN printf('%.2f', round(TRY_CAST(Temperatura AS DOUBLE), 9)) ELSE "
    + escape("Temperatura") + " END",
    *[f"coalesce(printf('%.2f', round(\"{m}\", 9)), 'nan')" for m in ["Accuracy", "F1-Score", "Precision", "Recall"]],
])
ORACLE["report_rows"] = with_rep(
    "SELECT Modelo, Categoria, Temperatura, rn_g = 1 AS show_group, n_g AS group_rows, rn_s = 1 AS show_sub, "
    "n_s AS sub_rows, coalesce(prev <> Modelo, false) AS rule_before, "
    "'    ' || " + _CELLS + " || ' \\\\' AS row_text FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY Modelo ORDER BY {_ORD}) AS rn_g, count(*) OVER (PARTITION BY Modelo) AS n_g, "
    "row_number() OVER (PARTITION BY Modelo, Categoria ORDER BY TRY_CAST(Temperatura AS DOUBLE) NULLS LAST, Temperatura) AS rn_s, "
    "count(*) OVER (PARTITION BY Modelo, Categoria) AS n_s, "
    f"lag(Modelo) OVER (ORDER BY Modelo, {_ORD}) AS prev FROM rep)")
ORACLE["group_sizes"] = with_rep("SELECT Modelo, Categoria, count(*) AS n_rows FROM rep GROUP BY ALL")
ORACLE["sorted_report"] = with_rep(f"SELECT Modelo, Categoria, Temperatura, {R4} FROM rep")
ORACLE["best_config"] = with_rep(
    'SELECT Modelo, Temperatura, round("F1-Score", 6) AS "F1-Score" FROM (SELECT *, row_number() OVER '
    '(PARTITION BY Modelo ORDER BY "F1-Score" DESC, TRY_CAST(Temperatura AS DOUBLE) ASC) AS rn FROM ovr) WHERE rn = 1')
ORACLE["topk_models"] = with_rep(
    'SELECT Modelo, Temperatura, round("Accuracy", 6) AS "Accuracy" FROM ovr ORDER BY "Accuracy" DESC, Modelo, '
    'Temperatura LIMIT 3')
ORACLE["unified_runs"] = _ctes(GEN) + (
    "SELECT model, temperature, count(*) AS n, round(sum(latency_s), 6) AS total_latency_s, "
    f"CASE WHEN model IN ({', '.join(repr(m) for m in A.VARIANT_B_MODELS)}) THEN count(*) ELSE 0 END AS n_with_usage "
    "FROM gen GROUP BY model, temperature")
ORACLE["latest_run"] = with_base(
    ", macro_c AS (SELECT model, temperature, avg(accuracy) AS accuracy FROM summ GROUP BY ALL), "
    "acc_x AS (SELECT model, temperature, field, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) / count(*) AS accuracy "
    "FROM pairs WHERE NOT is_skipped GROUP BY ALL), "
    "macro_x AS (SELECT model, temperature, avg(accuracy) AS accuracy FROM acc_x GROUP BY ALL) "
    "SELECT model, temperature, CASE WHEN temperature = 0.5 THEN 'exclude' ELSE 'compat' END AS mode, "
    "strftime(epoch_ms((CAST(1750000000 AS BIGINT) + CASE WHEN temperature = 0.5 THEN 3600 ELSE 0 END) * 1000), "
    "'%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp_avaliacao, "
    "round(CASE WHEN temperature = 0.5 THEN x.accuracy ELSE c.accuracy END, 6) AS accuracy "
    "FROM macro_c c JOIN macro_x x USING (model, temperature)").replace("WITH \ntruth", "WITH \ntruth")

ORACLE["run_summary_rows"] = with_base(
    "SELECT model, temperature, field AS \"Categoria\", printf('%.4f', round(accuracy, 9)) AS \"Accuracy\", "
    "printf('%.4f', round(f1_score_weighted, 9)) AS \"F1-Score (Weighted)\", printf('%.4f', round(precision_weighted, 9)) AS "
    "\"Precision (Weighted)\", printf('%.4f', round(recall_weighted, 9)) AS \"Recall (Weighted)\" FROM summ UNION ALL "
    f"SELECT model, temperature, '{K.OVERALL_CATEGORY}', printf('%.4f', round(avg(accuracy), 9)), printf('%.4f', round(avg(f1_score_weighted), 9)), "
    "printf('%.4f', round(avg(precision_weighted), 9)), printf('%.4f', round(avg(recall_weighted), 9)) FROM summ GROUP BY model, temperature")
ORACLE["report_csv_rows"] = with_rep(
    "SELECT Modelo, Temperatura, Categoria, printf('%.4f', round(\"Accuracy\", 9)) AS \"Accuracy\", "
    "printf('%.4f', round(\"F1-Score\", 9)) AS \"F1-Score\", printf('%.4f', round(\"Precision\", 9)) AS \"Precision\", "
    "printf('%.4f', round(\"Recall\", 9)) AS \"Recall\" FROM rep")

ORACLE["display_report"] = with_rep('SELECT Modelo, Temperatura AS "Temp.", round("Accuracy", 6) AS "Accuracy", '
                                    'round("Tempo de Execucao Total (s)", 6) AS "Tempo (s)" FROM ovr')
ORACLE["document_report"] = ORACLE["flatten_reports"]
ORACLE["overall_csv_rows"] = with_rep("SELECT Modelo, Temperatura, " + ", ".join(
    f"printf('%.4f', round(\"{c}\", 9)) AS \"{c}\"" for c in
    ["Accuracy", "F1-Score", "Precision", "Recall", "Tempo de Execucao Total (s)"]) + " FROM ovr")
oracle("no_vocab_metrics", f"""
, lab AS (SELECT DISTINCT model, temperature, field, unnest([y_true, y_pred]) AS label FROM counts),
obs AS (SELECT l.model, l.temperature, l.field, l.label, sum(CASE WHEN y_true = l.label THEN n ELSE 0 END) AS st,
        sum(CASE WHEN y_pred = l.label THEN n ELSE 0 END) AS sp,
        sum(CASE WHEN y_true = l.label AND y_pred = l.label THEN n ELSE 0 END) AS tp
        FROM lab l JOIN counts c USING (model, temperature, field) GROUP BY ALL)
SELECT model, temperature, field, round(sum(tp) / sum(st), 6) AS accuracy,
  round(sum(st * CASE WHEN sp > 0 THEN tp / sp ELSE 0 END) / sum(st), 6) AS precision_weighted,
  round(sum(tp) / sum(st), 6) AS recall_weighted,
  round(sum(st * CASE WHEN st + sp > 0 THEN 2 * tp / (st + sp) ELSE 0 END) / sum(st), 6) AS f1_score_weighted,
  CAST(NULL AS VARCHAR) AS error
FROM obs GROUP BY ALL""")
oracle("empty_field", """SELECT model, temperature, field, n_items, CAST(NULL AS VARCHAR) AS error FROM summ UNION ALL
SELECT DISTINCT model, temperature, 'Unseen', 0, 'Listas de entrada vazias.' FROM counts""")
_VEC = "[length({0}), length({0}) - length(replace({0}, 'a', '')), length({0}) - length(replace({0}, 'e', '')), length({0}) - length(replace({0}, 'n', ''))]::DOUBLE[]"
oracle("text_similarity", f"""WITH t AS (SELECT conv_id, turn, role, {norm('text')} AS x FROM conversations),
v AS (SELECT conv_id, turn, role, CASE WHEN x <> '' THEN {_VEC.format('x')} END AS e FROM t)
SELECT a.conv_id, a.turn, round(CASE WHEN list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0 THEN
  list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) END, 6) AS cosine
FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'""", base=False)
oracle("api_seconds", _ctes(GEN) + "SELECT model, temperature, property_id, round(latency_s, 6) AS seconds FROM gen "
       "WHERE latency_s IS NOT NULL", base=False)
oracle("label_lists", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform("
       "string_split(p_type, ' '), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS labels FROM part", base=False)

# ------------------------------------------------------------ files written and scanned again
oracle("rewritten_runs", _GENP + "SELECT model, temperature, count(*) AS n_items, count(DISTINCT property_id) AS n_properties, "
       f"count(*) FILTER (status_geracao = '{K.STATUS_OK}') AS n_success FROM parsed "
       f"WHERE model <> '{A.MODELS[0]}' OR status_geracao = '{K.STATUS_OK}' GROUP BY ALL", base=False)
oracle("resumed_generation", f"SELECT conv_id AS request_id, model, temperature, CASE WHEN prompt = '' THEN 'falha' ELSE 'sucesso' END "
       f"AS status_api_call, {RESP} AS raw_answer, CASE WHEN model = '{A.MODELS[0]}' THEN 'first' ELSE 'second' END AS job "
       f"FROM ({PROMPTS}) CROSS JOIN ({_MODELS_SQL}) CROSS JOIN ({_TEMPS_SQL})", base=False)
oracle("truth_positions", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size < 5 THEN 1 WHEN p_size < 25 THEN 2 ELSE 3 END, "
       "p_partkey) - 1 AS dataset_idx, p_name || ', ' || p_type AS name, p_size = 7 AS malformed FROM part", base=False)
oracle("scanned_runs", _GENP + "SELECT model, temperature, count(*) AS n_items, count(*) FILTER (ok) AS n_parsed, "
       "sum(length(raw_answer))::BIGINT AS raw_chars, round(sum(latency_s), 6) AS latency_s, 1.5::DOUBLE AS run_time_s "
       "FROM parsed GROUP BY ALL UNION ALL SELECT 'broken.json', NULL, 1, NULL, NULL, NULL, NULL", base=False)
oracle("image_tree", "SELECT dir, 2 AS n_images, sum(strlen(url) + 1 + 33)::BIGINT AS bytes, FROM "
       "(SELECT *, 'site_' || (page_id // 100) AS dir FROM pages) GROUP BY dir "
       "HAVING bool_or(page_id IN (SELECT doc_id FROM labels WHERE quality = 1))", base=False)
oracle("prompt_requests", "SELECT c_custkey, prompt FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN ("
       "SELECT n_regionkey AS r, string_agg(n_name || chr(10), '' ORDER BY n_name) AS prompt FROM nation JOIN region "
       "ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' GROUP BY n_regionkey) ON r = n_regionkey", base=False)
ORACLE["text_report_lines"] = (
    "SELECT row_number() OVER (ORDER BY Modelo, Categoria, Temperatura, k) - 1 AS line_no, line FROM ("
    "SELECT *, unnest(CASE WHEN rule_before THEN [0, 1] ELSE [1] END) AS k, "
    f"CASE k WHEN 0 THEN '{K.RULE_LINE}' ELSE row_text END AS line FROM (" + ORACLE["report_rows"] + "))")
oracle("run_latencies", _ctes(GEN) + "SELECT model, quantile, n, "
       "round(pow(1.01 / 0.99, ceil(ln(latency_s) / ln(1.01 / 0.99))) * (2 / (1.01 / 0.99 + 1)), 6) AS value FROM ("
       "SELECT model, latency_s, row_number() OVER (PARTITION BY model ORDER BY latency_s) AS r, count(*) OVER (PARTITION BY model) AS n "
       "FROM gen WHERE latency_s IS NOT NULL) JOIN (SELECT unnest([0.01, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS quantile) "
       "ON r = ceil(quantile * n)", base=False)
oracle("named_documents", "SELECT model || unnest([':x', '/x']) AS model, temperature, "
       "translate(field, ' çãáé', '_caae') AS category_key, round(accuracy, 6) AS accuracy FROM summ")
ORACLE["report_csv_back"] = (
    "SELECT Modelo, Temperatura, Categoria, " + ", ".join(f"\"{m}\"::DOUBLE AS \"{m}\"" for m in ["Accuracy", "F1-Score", "Precision", "Recall"])
    + " FROM (" + ORACLE["report_csv_rows"] + ")")
oracle("pattern_grid", f"SELECT model, temperature, count(*) AS n_items FROM documents CROSS JOIN (SELECT unnest("
       f"['{A.MODELS[0]}', '{A.MODELS[1]}', 'delta-vl:70b']) AS model) CROSS JOIN ({_TEMPS_SQL}) GROUP BY ALL", base=False)
