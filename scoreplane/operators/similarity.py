"""Similarity of paired vectors or texts."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreplane.functions.text import normalize_text
from scoreplane.functions.vectors import cosine_similarity, dot, norm


def neighbour_pairs(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", step: int = 1) -> DataFrame:
    """Pairs (key, key + step) by an equi-join on the shifted key; AQE picks the strategy.

    Each vector's norm is taken once, before the join."""
    v = vectors.select(F.col(key).alias("k"), F.col(vec).alias("v"), norm(vec).alias("n"))
    a = v.select(F.col("k").alias("left_id"), F.col("v").alias("left_vec"), F.col("n").alias("left_norm"))
    b = v.select(F.col("k").alias("right_id"), F.col("v").alias("right_vec"), F.col("n").alias("right_norm"))
    return a.join(b, b["right_id"] == a["left_id"] + step)


def cosine_pairs(pairs: DataFrame, left: str = "left_vec", right: str = "right_vec") -> DataFrame:
    """Adds the cosine of two vector columns, from ready norms where the pairs carry them."""
    if {"left_norm", "right_norm"} <= set(pairs.columns):
        product = F.col("left_norm") * F.col("right_norm")
        return pairs.withColumn("cosine", F.when((F.size(left) > 0) & (F.size(right) > 0) & (product > 0), dot(left, right) / product))
    return pairs.withColumn("cosine", cosine_similarity(left, right))


def embed_texts(df: DataFrame, text_col: str, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                out_col: str = "embedding") -> DataFrame:
    """Embed a text column with an injected encoder, one encoder per task.

    Iterator pandas UDF: the encoder is built once per task and fed Arrow batches.
    Texts are normalised first; empty texts give null."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder_factory()
        for s in batches:
            mask = (s.notna() & (s.str.len() > 0)).tolist()
            values = s.tolist()
            out: list = [None] * len(values)
            keep = [i for i, ok in enumerate(mask) if ok]
            if keep:
                vecs = enc([values[i] for i in keep])
                for i, v in zip(keep, vecs):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return df.withColumn(out_col, encode(normalize_text(text_col)))
