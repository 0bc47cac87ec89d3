"""Binary payloads and paths: base64, data URLs, MIME types, base names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreplane import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_base64(c) -> Column:
    """Unchunked base64 of bytes (Spark may insert CRLF every 76 chars)."""
    return F.regexp_replace(F.base64(_col(c)), r"[\r\n]", "")


def extension(path) -> Column:
    """Lower-case extension of the last path segment, '' if none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^./]+)$", 1))


def mime_type(path) -> Column:
    ext = extension(path)
    out = F.lit(K.DEFAULT_IMAGE_MIME)
    for e, mime in reversed(list(K.IMAGE_MIME.items())):
        out = F.when(ext == e, F.lit(mime)).otherwise(out)
    return out


def data_url(content, path) -> Column:
    """'data:<mime>;base64,<payload>' (E17)."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), to_base64(content))


def basename(path) -> Column:
    """Last '/'-separated segment."""
    return F.element_at(F.split(_col(path), "/"), -1)


def is_image_name(path) -> Column:
    return extension(path).isin(K.IMAGE_EXTENSIONS)


def looks_like_base64(c) -> Column:
    """A base64 payload pasted where a path is expected."""
    text = _col(c)
    starts = None
    for p in K.BASE64_MAGIC_PREFIXES:
        cond = F.startswith(text, F.lit(p))
        starts = cond if starts is None else (starts | cond)
    return F.coalesce((F.length(text) > K.BASE64_MIN_LENGTH) & starts, F.lit(False))
