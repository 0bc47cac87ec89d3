"""Exact dedup by deterministic block naming (DataFrame functions only).

Each text is cut into fixed-size blocks.  The distinct blocks are sorted and get integer
names; then the names of adjacent blocks are paired, the distinct pairs are sorted and
named in turn, and so on until one name is left for each document.  Equal (level, name)
holds exactly for equal texts, as each name decodes to one pair of names and, at level 0,
to one block.

Rows travel by the digest of a block; names are given to distinct (digest, block) pairs, and a
digest that two different blocks share (never seen with SHA-256, forced in a test) sends the
whole step along the blocks themselves.  Copies meet in map-side aggregation before any
shuffle, so a text that holds a third of all rows costs one row a task.

Defined results: a null text counts as empty; a null id is the smallest id; of rows equal
in id and text exactly one stays; a very long text is cut into as many blocks as it needs and named whole; an empty table gives an empty result; columns of the
input are never looked up beyond the id and the text, so extra names cannot clash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

BLOCK_CHARS = 16384
DIGEST = "UNHEX(SHA2(b, 256))"


def _blocks(text: str, block_chars: int) -> str:
    """SQL for the array of fixed-size blocks; an empty text is one empty block."""
    whole = f"COALESCE(`{text}`, '')"
    return (f"IF(LENGTH({whole}) <= {block_chars}, ARRAY({whole}),"
            f" REGEXP_EXTRACT_ALL({whole}, '(?s).{{1,{block_chars}}}', 0))")


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sorted distinct rows with integer names, written once so that names never change."""
    rows = distinct.sortWithinPartitions(*keys)
    return stored(rows.select(*[k for k in keys if k != "b"], F.monotonically_increasing_id().alias("name")), name)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS,
               digest: str = DIGEST) -> DataFrame:
    """One row per input row: uid, id, text_sha256 and the identity (level, name) of its text."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("id"),
                       F.expr(f"SHA2(COALESCE(`{text}`, ''), 256)").alias("text_sha256"),
                       F.expr(_blocks(text, block_chars)).alias("blocks"))
    blocks = docs.select(F.explode(F.expr(_blocks(text, block_chars))).alias("b"))
    distinct = blocks.select(F.expr(digest).alias("d"), "b").distinct()
    names = _named(distinct, ["d", "b"], "block-names")
    if names.groupBy("d").count().where("count > 1").isEmpty():
        base = stored(rows.withColumn("blocks", F.expr(f"TRANSFORM(blocks, b -> {digest})")), "blocks")
    else:  # two blocks share a digest: name and join by the blocks themselves
        base = stored(rows, "blocks")
        names = stored(distinct.sortWithinPartitions("b").select(
            F.col("b").alias("d"), F.monotonically_increasing_id().alias("name")), "block-names")

    single = base.where("SIZE(blocks) = 1").select("uid", "id", "text_sha256", F.expr("blocks[0]").alias("d"))
    done = [single.join(names, "d").select("uid", "id", "text_sha256", F.lit(0).alias("level"), "name")]
    long = base.where("SIZE(blocks) > 1")
    most = base.agg(F.max(F.size("blocks"))).first()[0] or 1
    if most > 1:
        level = stored(long.select("uid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "d"))
                       .join(names, "d").select("uid", "n", "pos", "name"), "level-0")
        keys = long.select("uid", "id", "text_sha256")
        for k in range(1, math.ceil(math.log2(most)) + 1):
            pairs = level.where("n > 1").groupBy("uid", "n", F.expr("pos DIV 2").alias("pos")).agg(
                F.expr("MAX(IF(pos % 2 = 0, name, NULL))").alias("l"),
                F.expr("COALESCE(MAX(IF(pos % 2 = 1, name, NULL)), -1)").alias("r"))
            pairs = stored(pairs, f"pairs-{k}")
            named = _named(pairs.select("l", "r").distinct(), ["l", "r"], f"pair-names-{k}")
            level = stored(pairs.join(named, ["l", "r"]).select(
                "uid", F.expr("INT((n + 1) DIV 2)").alias("n"), "pos", "name"), f"level-{k}")
            done.append(level.where("n = 1").join(keys, "uid").select(
                "uid", "id", "text_sha256", F.lit(k).alias("level"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 block_chars: int = BLOCK_CHARS, digest: str = DIGEST) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; the largest id of equal texts stays."""
    named = stored(identities(docs, doc_id, text, block_chars, digest), "identities")
    # written, so that the join deals both sides anew and may split a group that holds a third of all rows
    groups = named.groupBy("level", "name").agg(F.max(F.struct("id", "uid")).alias("keep"),
                                                F.count(F.lit(1)).alias("group_size"))
    return named.join(stored(groups, "groups"), ["level", "name"]).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", F.expr("uid = keep.uid").alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came.

    Of rows equal in id and text, the one whose other columns are largest stays."""
    columns = docs.columns
    kept = exact_groups(docs, doc_id, text, **options).where("kept").select(
        F.expr("CONCAT(IF(id IS NULL, 'n', CONCAT('v', CAST(id AS STRING))), ':', text_sha256)").alias("k"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                       F.expr(f"CONCAT(IF(`{doc_id}` IS NULL, 'n', CONCAT('v', CAST(`{doc_id}` AS STRING))), ':',"
                              f" SHA2(COALESCE(`{text}`, ''), 256))").alias("k"))
    return rows.join(kept.hint("merge"), "k", "left_semi").groupBy("k").agg(F.max("row").alias("row")).select("row.*")


