"""Helpers for building expressions as SQL text.

An expression written as SQL text crosses into the JVM once (``F.expr``); the
same expression assembled from Python Column calls costs one round trip per
node, which dominated plan construction for the parse and label expressions."""

from __future__ import annotations


def lit(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def let(value_sql: str, var: str, body_sql: str) -> str:
    """Evaluate ``value_sql`` once, bind it to ``var`` inside ``body_sql``."""
    return f"transform(array({value_sql}), {var} -> {body_sql})[0]"
