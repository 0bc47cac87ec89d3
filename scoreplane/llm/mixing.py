"""Mixing sources to target weights by a van der Corput schedule (DataFrame functions only).

Every source's documents are shuffled (by a digest of id and text) into one stream of words and
cut into blocks of equal word counts.  The targets fix how many blocks each source gives;
the blocks of all sources, laid end to end, are the cumulative weights in whole slots.
The van der Corput point of a position (its bits reversed) says when that position is
served, so every stretch of the schedule holds the sources near their weights.  Slots are
ranked per source in the order of the schedule; rank r takes block r of the source's
stream, starting over at the end of the stream, and the last slot takes what is left of
the target.  The schedule is joined with the blocks.

No window sees a whole source: prefix sums and ranks run in chunks that grow in number
with the data, plus one small table of chunk totals.  Only rows equal in id and text lie in one chunk whatever their number.

Defined results: null texts have size 0 and are never taken; a null source is a source of
its own, the last; documents of size 0 give taken 0; a very long text is counted whole and spans many blocks; rows equal in id and text share their
words by position; an empty table gives an empty result; a clashing extra column is never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

BLOCK_WORDS = 256
CHUNK = 8192
MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)


def words_in(text: str) -> str:
    """SQL for the number of words, without an array of them: a word and the gap behind it become one sign."""
    gap, word = r"[\\x20\\x09-\\x0D]", r"[^\\x20\\x09-\\x0D]"
    trimmed = f"REGEXP_REPLACE(COALESCE(`{text}`, ''), '^{gap}+', '')"
    return f"LENGTH(REGEXP_REPLACE({trimmed}, '{word}++{gap}*+', 'x'))"


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """uid, id, source, size and the shuffle order of every row, written once; whole texts are read here only.

    The order goes by a digest of the id and the text, so rows without an id, or of one id, spread over the stream as others do."""
    return stored(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").cast("bigint").alias("id"),
        F.col(f"`{source}`").cast("string").alias("source"), F.expr(words_in(text)).cast("bigint").alias("size"),
        F.expr(f"MD5(CONCAT('mix:', COALESCE(CAST(`{doc_id}` AS STRING), 'null'), ':', MD5(COALESCE(`{text}`, ''))))")
        .alias("ord")), "sized")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: sid, source, source_size, target (double).

    Weights go by the sources' order of code points, null last.  The targets share all words by
    weight; none exceeds ``max_epochs`` times its source.  A source is capped exactly if its cap per weight
    is below the level that the sources with a larger cap per weight share."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = "ELEMENT_AT(ARRAY({}), INT((sid - 1) % {}) + 1)".format(",".join(map(str, weights)), len(weights))
    t = totals.withColumn("sid", F.row_number().over(order)).withColumn("w", F.expr(w).cast("double"))
    t = t.withColumn("cap", F.expr(f"source_size * {max_epochs}L"))
    before = Window.orderBy(F.expr("cap / w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.expr("cap / w"), "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / F.sum("w").over(onward))
    # the level at the first source that is not capped holds for all later ones
    return t.withColumn("first", F.min(F.expr("IF(level * w <= cap, STRUCT(cap / w AS r, sid AS s, level AS share), NULL)"))
                        .over(every)).selectExpr(
        "sid", "source", "source_size",
        "IF(first IS NULL OR cap / w < first.r OR (cap / w = first.r AND sid < first.s), DOUBLE(cap), first.share * w)"
        " AS target")


def _chunked_prefix(rows: DataFrame, group: str, chunk: str, value: str) -> DataFrame:
    """(group, chunk, base): the sum of ``value`` in all earlier chunks of the group."""
    totals = rows.groupBy(group, chunk).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(group, chunk, F.coalesce(F.sum("v").over(w), F.lit(0)).alias("base"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """One row per slot: slot (its place in the schedule), sid, rank, epoch, block, words it takes."""
    quota = targets.where("source_size > 0").selectExpr("sid", "source_size", "BIGINT(ROUND(target)) AS quota").selectExpr(
        "*", f"(source_size + {block_words - 1}) DIV {block_words} AS blocks",
        f"(quota DIV source_size) * ((source_size + {block_words - 1}) DIV {block_words})"
        f" + (quota % source_size + {block_words - 1}) DIV {block_words} AS slots")
    upto = Window.orderBy("sid")
    quota = stored(quota.withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.expr("hi - slots")), "quota")
    n = quota.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (max(n, 1) - 1).bit_length())
    width = max(1, (1 << bits) // max(1, -(-n // chunk)))
    spans = quota.where("slots > 0").selectExpr(
        "*", f"EXPLODE(SEQUENCE(lo DIV {chunk}, (hi - 1) DIV {chunk})) AS c")
    spans = spans.repartition(max(1, -(-n // chunk)), "c")
    points = spans.selectExpr("sid", "source_size", "blocks", "quota", f"EXPLODE(SEQUENCE(GREATEST(lo, c * {chunk}),"
                              f" LEAST(hi, (c + 1) * {chunk}) - 1)) AS v")
    slots = points.selectExpr("*", f"CAST(CONV(REVERSE(LPAD(BIN(v), {bits}, '0')), 2, 10) AS BIGINT) AS slot")
    slots = slots.withColumn("part", F.expr(f"slot DIV {width}L")).withColumn("one", F.lit(1))
    base = _chunked_prefix(slots, "sid", "part", "one")
    ranked = slots.withColumn("in_part", F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")))
    # the planner takes exploded ranges for as small as the rows they came from, so neither side may be broadcast
    ranked = ranked.join(base.hint("merge"), ["sid", "part"]).withColumn("rank", F.expr("base + in_part - 1"))
    return ranked.selectExpr("slot", "sid", "rank", "rank DIV blocks AS epoch", "rank % blocks AS block",
                             f"LEAST({block_words}L, quota - (rank DIV blocks) * source_size - (rank % blocks) * {block_words}L,"
                             f" source_size - (rank % blocks) * {block_words}L) AS words")


def pieces(rows: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """The shuffled streams cut into blocks: uid, sid, block, and the words [a, b) of the block that are the document's."""
    n = rows.count()
    buckets = max(1, -(-n // chunk))
    keyed = rows.where("size > 0").join(targets.select("sid", F.col("source").alias("s")), F.expr("source <=> s")).selectExpr(
        "uid", "id", "sid", "size", "ord",
        f"(CAST(CONV(SUBSTR(ord, 1, 8), 16, 10) AS BIGINT) * {buckets}L) DIV 4294967296L AS bucket")
    inside = Window.partitionBy("sid", "bucket").orderBy("ord", "id", "size", "uid")
    base = _chunked_prefix(keyed, "sid", "bucket", "size")
    placed = keyed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(base, ["sid", "bucket"]).selectExpr("uid", "sid", "base + upto - size AS a", "base + upto AS b")
    return placed.selectExpr("uid", "sid", "a", "b", f"EXPLODE(SEQUENCE(a DIV {block_words}L, (b - 1) DIV {block_words}L)) AS block"
                             ).selectExpr("uid", "sid", "block", f"GREATEST(a - block * {block_words}L, 0L) AS a",
                                          f"LEAST(b - block * {block_words}L, {block_words}L) AS b")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, mix); mix has a row per slot and document piece: slot, sid, uid, epoch, block, a, b."""
    rows = sized(docs, doc_id, text, source)
    targets = stored(source_targets(rows), "targets")
    slots = schedule(targets, block_words, chunk)
    mix = slots.hint("merge").join(pieces(rows, targets, block_words, chunk), ["sid", "block"]).where("a < words").selectExpr(
        "slot", "sid", "uid", "epoch", "block", "a", "LEAST(b, words) AS b")
    return rows, targets, mix


def mix_totals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, taken (words, repeats counted)."""
    rows, targets, mix = mixed(docs, doc_id, text, source, block_words, chunk)
    taken = mix.groupBy("uid").agg(F.sum(F.expr("b - a")).alias("t"))
    facts = targets.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(taken, "uid", "left").join(facts, F.expr("source <=> s")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.expr("COALESCE(t, 0L)").alias("taken"))
