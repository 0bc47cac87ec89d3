"""Text expressions: normalisation, canonical labels, slugs, names, numbers, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreplane import constants as K
from scoreplane.functions.sqltext import ident, lit

# Every character Python's ``str.split()`` treats as whitespace.  ``\s`` in Java
# regexes is ASCII-only and misses \x1c-\x1f, NEL, NBSP and the Unicode spaces.
WHITESPACE_CLASS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Whitespace other than ' ' that Python's ``str.split()`` splits on.
_OTHER_WS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000")
_OTHER_WS_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in _OTHER_WS) + "'"
_SPACES_SQL = "'" + " " * len(_OTHER_WS) + "'"


def normalize_sql(x: str) -> str:
    """SQL text of :func:`normalize_text` over the SQL expression ``x``.

    A character map turns every whitespace character into ' ' (cheap, no regex),
    then only runs of two or more spaces are rewritten; a full strip is a trim."""
    return f"trim(regexp_replace(translate(lower({x}), {_OTHER_WS_SQL}, {_SPACES_SQL}), '  +', ' '))"


def canonical_sql(x: str) -> str:
    """SQL text of :func:`canonical_label` over the SQL expression ``x``."""
    return (f"transform(array({normalize_sql(f'CAST({x} AS STRING)')}), n -> "
            f"CASE WHEN n IS NULL OR n = '' THEN {lit(K.NA_LABEL)} ELSE n END)[0]")


def normalize_text(c) -> Column:
    """lower, strip, collapse runs of whitespace to one space."""
    if isinstance(c, str):
        return F.expr(normalize_sql(ident(c)))
    spaced = F.translate(F.lower(c), _OTHER_WS, " " * len(_OTHER_WS))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def canonical_label(c) -> Column:
    """null or blank -> 'na'; otherwise the normalised text."""
    if isinstance(c, str):
        return F.expr(canonical_sql(ident(c)))
    norm = normalize_text(c.cast("string"))
    return F.coalesce(F.nullif(norm, F.lit("")), F.lit(K.NA_LABEL))


def missing_token_to_null(c) -> Column:
    """CSV cells holding a missing-value token become null (Q2)."""
    col = _col(c)
    return F.when(col.isin(K.CSV_NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def slug(c) -> Column:
    """space -> '_', fold ç ã á é."""
    return F.translate(_col(c), K.SLUG_FROM, K.SLUG_TO)


def safe_model_name(c) -> Column:
    """':' and '/' -> '_' so a model name can sit in a file name."""
    return F.translate(_col(c), ":/", "__")


def safe_temperature(c) -> Column:
    """0.5 -> '0p5' (E4)."""
    return F.translate(_col(c).cast("string"), ".", "p")


def evaluation_file_name(model, temperature) -> Column:
    return F.concat(
        F.lit(K.EVAL_FILE_PREFIX), safe_model_name(model), F.lit("_temp_"),
        safe_temperature(temperature), F.lit(".json"),
    )


_FILE_NAME_PATTERN = r"evaluation_metrics_(.+?)_temp_([\d_p]+)\.json"


def model_from_file_name(c) -> Column:
    """Model part of an evaluation file name, run stamp removed (E5).

    Only the temperature gets its 'p' turned back into '.', so
    'vision-2.5-pro' keeps its 'p' (Q15)."""
    part = F.nullif(F.regexp_extract(_col(c), _FILE_NAME_PATTERN, 1), F.lit(""))
    return F.regexp_replace(F.translate(part, "_", ":"), r"^(.+?):\d{8}:\d{6}.*$", "$1")


def temperature_from_file_name(c) -> Column:
    part = F.nullif(F.regexp_extract(_col(c), _FILE_NAME_PATTERN, 2), F.lit(""))
    return F.translate(part, "p", ".")


def first_present(*cols) -> Column:
    """First non-null value."""
    return F.coalesce(*[_col(c) for c in cols])


def nonzero_or(primary, fallback) -> Column:
    """``primary or fallback`` with Python truthiness on numbers (Q12): 0 falls through."""
    return F.coalesce(F.nullif(_col(primary), F.lit(0)), _col(fallback))


def to_number(c) -> Column:
    """Text to double, anything unparsable -> null."""
    return F.expr(f"try_cast({_sql(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def escape_sql(x: str, model_name: bool = False) -> str:
    """SQL text of :func:`escape_special` over the SQL expression ``x``."""
    out = f"CAST({x} AS STRING)"
    if model_name:
        out = f"replace({out}, '_', ':')"
    for old, new in K.TEXT_ESCAPES:
        out = f"replace({out}, {lit(old)}, {lit(new)})"
    return out


def settled(c) -> Column:
    """A metric as reports print it: rounded to 9 places, once.

    A sum of doubles taken in a different order (another partitioning, another engine) differs in the
    last bits, and near a decimal tie that flips the printed digit; rounding collapses such neighbours."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def fixed(c, places: int = 2) -> Column:
    """Fixed-point text, half-even on the binary value, no grouping (E8); the number is taken as it is.

    Known residue: a number whose only printed digit would be its rounded half (0.00005 at 4 places)
    counts as an exact tie and prints as zero."""
    x = F.col(c) if isinstance(c, str) else c
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places if places > 0 else "0"))


def escape_special(c, model_name: bool = False) -> Column:
    """Escape table special characters in the fixed order.

    The braces emitted for a backslash are escaped again by the later rules, as
    in the original report writer."""
    if isinstance(c, str):
        return F.expr(escape_sql(ident(c), model_name))
    out = c.cast("string")
    if model_name:
        out = F.replace(out, F.lit("_"), F.lit(":"))
    for old, new in K.TEXT_ESCAPES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
