"""Experiment grid, model availability, entity -> directory matching, request assembly
(J2, J4, J6, W3, F6, F8, P10, I4)."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreplane import constants as K
from scoreplane.functions.media import data_url, is_image_name


def wanted_models(names: Sequence[str], pattern: str = "") -> list[str]:
    """Requested model names without blanks, and only those that match ``pattern`` where one is given."""
    return [m for m in names if m and m.strip() and re.search(pattern, m)]


def experiment_grid(items: DataFrame, models: Sequence[str], temperatures: Sequence[float], pattern: str = "") -> DataFrame:
    """items x models x temperatures (J2) as a Generate over a literal config array:
    linear in the items, no join, nothing broadcast that grows with data.  Only models whose names match ``pattern`` (F6)."""
    models = wanted_models(models, pattern)
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(t)).alias("temperature"))
                     for m in models for t in temperatures])
    return items.select("*", F.explode(grid).alias("_g")).select("*", "_g.model", "_g.temperature").drop("_g")


def model_availability(spark: SparkSession, requested: Sequence[str], catalogue: DataFrame,
                       name_col: str = "name") -> DataFrame:
    """(model, available) for each requested model (J4): semi join for the kept,
    anti join for the skipped.  The request list is configuration (bounded)."""
    req = spark.createDataFrame([(m,) for m in requested if m and m.strip()],
                                T.StructType([T.StructField("model", T.StringType())]))
    cat = catalogue.select(F.col(name_col).alias("model")).distinct()
    ok = req.join(cat, "model", "left_semi").withColumn("available", F.lit(True))
    missing = req.join(cat, "model", "left_anti").withColumn("available", F.lit(False))
    return ok.unionByName(missing)


def catalogue_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Model names out of a JSON document ``{"models": [{"name": ...}, ...]}``."""
    parsed = F.from_json(col, "struct<models: array<struct<name: string>>>")
    return df.select(F.explode(parsed["models"]).alias("m")).select(F.col("m.name").alias("name")).distinct()


def match_directories(entities: DataFrame, dirs: DataFrame, entity_col: str = "entity_id",
                      dir_col: str = "dir_name") -> DataFrame:
    """First directory per entity: exact name, else ``<id>_*`` by name order.

    Two equi-joins (exact, and on the prefix before the first '_') unioned with a
    priority, then ``min(struct(priority, dir))`` per entity - a partially
    aggregated min, no window sort over a hot entity.  Ids containing '_' need
    the prefix at every '_' position; that is handled by exploding each
    directory's candidate prefixes (bounded by the name length)."""
    d = dirs.select(F.col(dir_col).alias("dir"))
    exact = entities.join(d, entities[entity_col] == d["dir"]).select(
        entities[entity_col].alias("_e"), F.lit(0).alias("priority"), "dir")
    # every prefix ending right before an '_' is a candidate id for '<id>_*'
    parts = F.split("dir", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                           lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    cand = d.filter(F.col("dir").contains("_")).select("dir", F.explode(prefixes).alias("prefix"))
    pref = entities.join(cand, entities[entity_col] == cand["prefix"]).select(
        entities[entity_col].alias("_e"), F.lit(1).alias("priority"), "dir")
    best = exact.unionByName(pref).groupBy("_e").agg(F.min(F.struct("priority", "dir")).alias("b"))
    out = entities.join(best, entities[entity_col] == best["_e"], "left")
    return out.select(
        entities[entity_col],
        F.col("b.dir").alias("dir"),
        F.when(F.col("b.priority") == 0, F.lit("exact")).when(F.col("b.priority") == 1, F.lit("prefix"))
        .otherwise(F.lit("none")).alias("match_kind"),
    )


def _images(files: DataFrame, path_col: str) -> DataFrame:
    """Direct children of a directory with an image extension: the directory's own name and the file's."""
    f = files.withColumn("dir", F.element_at(F.split(path_col, "/"), -2)).withColumn(
        "name", F.element_at(F.split(path_col, "/"), -1))
    return f.filter(is_image_name(F.col("name")))


def images_per_directory(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(dir, images) from a file listing (S6, F8): the image names of each directory, sorted.

    One request carries all images of its directory, so the list is bounded by what a request can hold."""
    return _images(files, path_col).groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("images"))


def encoded_images(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(dir, images) with every image of the directory as a data URL, by name."""
    f = _images(files, path_col).select("dir", F.struct("name", data_url(F.col(content_col), "name").alias("url")).alias("f"))
    return f.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["url"]).alias("images"))


def image_check(images_col: str = "images") -> Column:
    """Error text for a missing or empty image list, null otherwise (F8); the item is kept."""
    return F.when(F.coalesce(F.size(images_col), F.lit(0)) == 0, F.lit(K.ERR_NO_IMAGES))


def assemble_prompts(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
                     role_col: str = "role", text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """(conv_id, system, prompt, n_parts) (P10, S7): system text plus user turns in order.

    Per conversation the parts are collected once, sorted by turn; a request is by
    definition one record, so this is the natural unit of the collect."""
    is_sys = F.col(role_col) == "system"
    is_user = F.col(role_col) == "user"
    g = turns.groupBy(conv_col).agg(
        F.min_by(F.when(is_sys, F.col(text_col)), F.when(is_sys, F.col(order_col))).alias("system"),
        F.array_sort(F.collect_list(F.when(is_user, F.struct(F.col(order_col).alias("o"),
                                                               F.col(text_col).alias("t"))))).alias("_parts"))
    return g.select(conv_col, "system",
                    F.array_join(F.transform("_parts", lambda x: x["t"]), sep).alias("prompt"),
                    F.size("_parts").alias("n_parts"))


def request_struct(model: Column, temperature: Column, system: Column, prompt: Column,
                   images: Column | None = None) -> Column:
    """The request sent to a model (P10): model, system, prompt, options, images."""
    imgs = images if images is not None else F.array().cast("array<string>")
    return F.struct(model.alias("model"), system.alias("system"), prompt.alias("prompt"),
                    F.create_map(F.lit("temperature"), temperature.cast("string")).alias("options"),
                    imgs.alias("images"))
