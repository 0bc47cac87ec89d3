"""Label-set expressions for multi-label fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreplane.functions.sqltext import ident
from scoreplane.functions.text import normalize_sql, normalize_text


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_list(c, sep: str = ",") -> Column:
    """'a, b,c' -> ['a', 'b', 'c']; null -> []."""
    return F.coalesce(F.split(_col(c), r"\s*" + sep + r"\s*"), F.array().cast("array<string>"))


def label_set_sql(x: str) -> str:
    """SQL text of :func:`label_set` over the SQL expression ``x``."""
    return (f"array_sort(array_distinct(filter(transform(coalesce({x}, CAST(array() AS ARRAY<STRING>)), "
            f"ls_v -> {normalize_sql('ls_v')}), ls_w -> ls_w IS NOT NULL AND ls_w != '')))")


def label_set(items) -> Column:
    """Normalised, blank-free, de-duplicated label set."""
    if isinstance(items, str):
        return F.expr(label_set_sql(ident(items)))
    normed = F.transform(F.coalesce(_col(items), F.array().cast("array<string>")), lambda x: normalize_text(x))
    return F.array_sort(F.array_distinct(F.filter(normed, lambda x: x.isNotNull() & (x != ""))))


def multi_hot(items, vocab) -> Column:
    """0/1 per entry of the normalised, sorted vocabulary; OOV items are ignored."""
    s = label_set(items)
    return F.transform(label_set(_col(vocab)), lambda v: F.array_contains(s, v).cast("int"))
