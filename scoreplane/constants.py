"""Fixed values that must equal the evaluated pipeline's output for results to match.

Everything in this module is a literal the pipeline writes into its outputs or
compares against; it is kept together, in natural order, so it can be checked
at a glance.
"""

# --- fixed values: placeholder labels ------------------------------------
# Prediction written for an item whose generation or JSON parse failed.
FAILURE_LABEL = "NA_FALHA_GERACAO_OU_PARSE"
# Label written on both sides for an item whose dataset index is invalid.
SKIPPED_LABEL = "NA_ITEM_PULADO"
# Placeholders appended to every field vocabulary (normalised form).
VOCAB_PLACEHOLDERS = ["na_item_invalido_ou_pulado", "na_falha_geracao_ou_parse"]
# Label that null / blank values are folded into.
NA_LABEL = "na"

# --- fixed values: tokens a CSV reader treats as missing ------------------
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: generation status vocabulary ---------------------------
STATUS_OK = "processado_com_sucesso"
STATUS_API_ERROR = "erro_api"
STATUS_PARSE_ERROR = "erro_parsing_json"
STATUS_DIR_MISSING = "erro_diretorio_nao_encontrado"
CALL_OK = "sucesso"
CALL_FAILED = "falha"

# --- fixed values: JSON extraction error texts ------------------------------
ERR_EMPTY_RESPONSE = "Resposta do modelo vazia."
ERR_NO_JSON = "Nenhum padrão JSON (bloco ou chaves) encontrado."
ERR_PARSE_PREFIX = "Falha parse JSON (limpa)"

# --- fixed values: evaluation and generation notes ----------------------------
ERR_NO_PAIRS = "Listas de entrada vazias."
NOTE_NO_LABELS = "Todas as listas de benfeitorias estavam vazias ou resultaram em vetores vazios."
ERR_NO_IMAGES = "Nenhuma imagem codificada para API."
ERR_DIR_MISSING = ("Diretório para '", "' não encontrado.")

# --- fixed values: report layout --------------------------------------------
OVERALL_CATEGORY = "MÉDIA GERAL (Categorias)"
AVERAGES_KEY_PREFIX = "Metricas_Medias_Gerais_Do_Modelo_"
UNKNOWN_MODEL = "unknown_model"
TEMPERATURE_UNKNOWN = "N/A"
EVAL_FILE_PREFIX = "evaluation_metrics_"
REPORT_BY_CATEGORY_COLUMNS = [
    "Modelo", "Temperatura", "Categoria", "Accuracy", "F1-Score", "Precision", "Recall",
]
REPORT_OVERALL_COLUMNS = [
    "Modelo", "Temperatura", "Accuracy", "F1-Score", "Precision", "Recall",
    "Tempo de Execucao Total (s)",
]
RUN_SUMMARY_COLUMNS = [
    "Categoria", "Accuracy", "F1-Score (Weighted)", "Precision (Weighted)", "Recall (Weighted)",
]

# Report headings as they are displayed.
DISPLAY_NAMES = {"Temperatura": "Temp.", "Tempo de Execucao Total (s)": "Tempo (s)"}
RULE_LINE = r"    \midrule"
# A group's first cell (rows, text), a subgroup's (rows, text), and the cell of a missing number.
GROUP_CELL = r"\multirow{%d}{*}{\textbf{%s}}"
SUBGROUP_CELL = r"\multirow{%d}{*}{%s}"
NO_NUMBER = "nan"
ERR_NO_CATEGORIES = "Nenhuma categoria com métricas válidas para calcular a média geral."

# --- fixed values: slug folding (characters and replacements, in order) ----
SLUG_FROM = " çãáé"
SLUG_TO = "_caae"

# --- fixed values: special-character escapes for table text, in order -------
TEXT_ESCAPES = [
    ("\\", r"\textbackslash{}"),
    ("&", r"\&"),
    ("%", r"\%"),
    ("$", r"\$"),
    ("#", r"\#"),
    ("_", r"\_"),
    ("{", r"\{"),
    ("}", r"\}"),
    ("~", r"\textasciitilde{}"),
    ("^", r"\^{}"),
]

# --- fixed values: image files ----------------------------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp"]
# Extension -> MIME type; every other extension is sent as JPEG.
IMAGE_MIME = {"png": "image/png", "gif": "image/gif", "webp": "image/webp"}
DEFAULT_IMAGE_MIME = "image/jpeg"
# Base64 payloads pasted where a file path is expected start like this.
BASE64_MAGIC_PREFIXES = ["data:image", "UklGR", "R0lGO", "iVBOR", "/9j/"]
BASE64_MIN_LENGTH = 200
