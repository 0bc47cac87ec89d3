"""Extract and strictly parse a JSON object out of free model text.

All native expressions: no Python per row.  A parser stops behind the first complete value
and does not look at what follows, so the candidate is parsed twice: as the element of
``[...]`` and as the member of ``{"v":...}``.  Text behind it that closes the one wrapper early is
an error inside the other; the answer is valid iff the first gives exactly one object and the second exactly
one member.  This rejects trailing text, two objects, single quotes, raw control
characters inside strings, leading zeros and trailing commas, like a strict JSON
reader does; ``NaN`` and ``Infinity`` are accepted, as there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.functions.sqltext import ident, lit

FENCED_BLOCK = r"```json\s*(\{[\s\S]*?\})\s*```"
OUTER_BRACES = r"(?s)\{.*\}"
# Characters a strict reader refuses; kept: \b \t \n \f \r, printable ASCII, > 127.
CONTROL_CHARS = r"[\x{00}-\x{07}\x{0b}\x{0e}-\x{1f}\x{7f}]"

# Outside strings a plus sign stands in exponents only, and infinity has one spelling; the parser takes more.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
LOOSE_NUMBERS = r"(?<![eE])\+|INF"

_STRICT_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNumericLeadingZeros": "false",
    "allowNonNumericNumbers": "true",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
    "allowUnquotedControlChars": "false",
    "mode": "PERMISSIVE",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_candidate(c) -> Column:
    """First fenced ```json block, else first '{' .. last '}', else null."""
    text = _col(c)
    fenced = F.nullif(F.regexp_extract(text, FENCED_BLOCK, 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, OUTER_BRACES, 0), F.lit(""))
    return F.coalesce(fenced, braces)


def clean_json(c) -> Column:
    """Drop control characters a strict reader would refuse."""
    return F.regexp_replace(_col(c), CONTROL_CHARS, "")


def extract_json_sql(raw: str) -> str:
    """struct<parsed: map<string,string>, error: string> for the raw answer in the SQL expression ``raw``.

    Every intermediate (candidate, cleaned text, parsed map) is bound once: without that, an optimizer that
    substitutes aliases into pushed-down filters copies an expression once per reference, and chains of
    such steps grow exponentially."""
    opts = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in _STRICT_OPTIONS.items())
    cand = (f"coalesce(nullif(regexp_extract({raw}, {lit(FENCED_BLOCK)}, 1), ''), "
            f"nullif(regexp_extract({raw}, {lit(OUTER_BRACES)}, 0), ''))")
    clean = f"regexp_replace(jx_cand, {lit(CONTROL_CHARS)}, '')"
    wrapped = f"from_json(concat('[', jx_clean, ']'), 'array<map<string,string>>', map({opts}))"
    member = f"size(from_json(concat('{{\"v\":', jx_clean, '}}'), 'map<string,string>', map({opts}))) = 1"
    loose = (f"(contains(jx_clean, '+Inf') OR contains(jx_clean, 'INF')) AND "
             f"regexp_like(regexp_replace(jx_clean, {lit(STRING)}, '0'), {lit(LOOSE_NUMBERS)})")
    one = f"CASE WHEN size(jx_w) = 1 AND NOT ({loose}) THEN CASE WHEN {member} THEN element_at(jx_w, 1) END END"
    fold = ("map_from_entries(reverse(aggregate(reverse(map_entries(jx_one)), "
            "named_struct('k', cast(array() AS array<string>), 'e', cast(array() AS array<struct<key:string,value:string>>)), "
            "(acc, x) -> CASE WHEN array_contains(acc.k, x.key) THEN acc "
            "ELSE named_struct('k', array_append(acc.k, x.key), 'e', array_append(acc.e, x)) END).e))")
    dedupe = (f"CASE WHEN jx_one IS NULL THEN jx_one WHEN size(array_distinct(map_keys(jx_one))) = size(jx_one) "
              f"THEN jx_one ELSE {fold} END")
    err = (f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN {lit(K.ERR_EMPTY_RESPONSE)} "
           f"WHEN jx_cand IS NULL THEN {lit(K.ERR_NO_JSON)} "
           f"WHEN jx_parsed IS NULL THEN concat({lit(K.ERR_PARSE_PREFIX + '. Str: ' + chr(39))}, "
           f"substring(jx_clean, 1, 200), {lit('...' + chr(39))}) END")
    body = "named_struct('parsed', CASE WHEN jx_err IS NULL THEN jx_parsed END, 'error', jx_err)"
    from scoreplane.functions.sqltext import let as slet
    inner = slet(err, "jx_err", body)
    inner = slet(dedupe, "jx_parsed", inner)
    inner = slet(one, "jx_one", inner)
    inner = slet(wrapped, "jx_w", inner)
    inner = slet(clean, "jx_clean", inner)
    return slet(cand, "jx_cand", inner)


def with_extracted_json(df: DataFrame, raw_col: str, parsed_col: str = "parsed",
                        error_col: str = "json_parsing_error_msg") -> DataFrame:
    """Adds the parsed object and the error text of a raw answer column."""
    out = df.withColumn("_jx", F.expr(extract_json_sql(ident(raw_col))))
    return out.select("*", F.col("_jx.parsed").alias(parsed_col), F.col("_jx.error").alias(error_col)).drop("_jx")


def field_value(parsed, field) -> Column:
    """Value of a member by name as text, null when absent."""
    key = F.lit(field) if isinstance(field, str) else field
    return F.try_element_at(_col(parsed), key)
