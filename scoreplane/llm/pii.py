"""Personal data: base patterns, extended by bootstrapped contextual extraction (DataFrame functions only).

Base spans are the leftmost matches of four patterns that pass their checks.  They are the seeds
of the bootstrap.  The words around a span, whatever they are, form its lexical patterns, in which every number is
``#``; from the narrow to the backed-off: the two words before, the word before and the word behind, the word before
and the span's shape (letters ``a``, digits ``9``), the word before alone, which must be the surer.  A word that
begins beyond ``CONTEXT_CHARS`` characters before the span is in no pattern.  Candidate instances lie clear of all base spans: for e-mail, every word that holds a digit or a sign inside;
for the other kinds, every maximal run of digit groups with blanks, dots, brackets and hyphens between,
and every word with a digit that no run touches.  In the graph of patterns and instances, a
pattern's confidence for a kind is the weight of the kind's known instances among all
its instances that the kind can have (smoothed); an instance's weight is the noisy-or over the words it stands
behind, each with the surest of its accepted patterns, as these are not independent.
After a fixed number of rounds, candidates in accepted patterns are spans of the kind of the surest.

The patterns are written with possessive quantifiers and run starts, so a long run of digits or letters costs
linear time and no recursion.  Places come from the lengths of the pieces between matches.  Pattern and instance
counts are pre-aggregated before each shuffle, so a pattern before a third of all identifiers is one row a task.

Defined results: a null or empty text has no spans; a very long text is searched whole; an empty table gives no rows; of kinds equally sure the first counts; rows equal in id and text are reported each; a document
without spans gets empty lists; a null id stays null; other columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3.0  # weight of known instances that a pattern needs
MIN_CONFIDENCE = 0.7
BACKED_OFF = (5.0, 0.8)  # the same for patterns of one word
ROUNDS = 3
CONTEXT_CHARS = 64

RUN, WORD = 4, 5  # kinds of candidates
LONG_VALUE = 64  # longer instances go by their digest

SIGN = r"[^\p{L}\p{M}\p{N}\p{Z}\s]"
#: Digits that no letter or further digit of the same word follows.
GROUP = r"[0-9][0-9().\[\]-]*+(?!" + SIGN + r"*+[\p{L}\p{M}\p{N}])"
#: Base patterns, in the order of KINDS, then the candidates: runs of digit groups, words with a digit or a sign inside.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?+[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?:(?<!\S)|(?<=[\p{L}\p{M}][:=]))" + SIGN + "*+" + GROUP + r"(?:[ \t][ \t().\[\]-]*+" + GROUP + ")*+",
    r"(?<!\S)(?:[^\s0-9]*+[0-9]\S*+|" + SIGN + r"*+[\p{L}\p{M}\p{N}]++" + SIGN + r"++[\p{L}\p{N}]\S*+)",
)
#: A cheap test that a text can hold a match at all.
MAY_HOLD = ("INSTR(t, '@') > 0", r"t RLIKE '[0-9]\\.[0-9]'", "t RLIKE '[0-9]'", "INSTR(t, '+') > 0", "t RLIKE '[0-9]'",
            "t <> ''")
LUHN = ("AGGREGATE(SEQUENCE(1, LENGTH(d)), 0L, (a, i) -> a + IF(i % 2 = 1, INT(SUBSTRING(d, -i, 1)),"
        " (2 * INT(SUBSTRING(d, -i, 1))) DIV 10 + (2 * INT(SUBSTRING(d, -i, 1))) % 10)) % 10 = 0")
PASSES = {
    0: "TRUE",
    1: "FORALL(SPLIT(v, '[.]'), p -> LENGTH(TRIM(LEADING '0' FROM p)) <= 3 AND"
       " COALESCE(TRY_CAST(TRIM(LEADING '0' FROM p) AS INT), 0) <= 255)",
    2: f"CASE WHEN LENGTH(d) BETWEEN 13 AND 19 THEN {LUHN} ELSE FALSE END",
    3: "LENGTH(d) BETWEEN 9 AND 15",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(kind: int) -> str:
    """SQL for the matches of one pattern in ``t``: kind, number, length of the piece before, match, ends of the text around."""
    p = _quoted(PATTERNS[kind])
    none = "CAST(ARRAY() AS ARRAY<STRUCT<kind: INT, n: INT, gap: INT, v: STRING, l: STRING, r: STRING>>)"
    # the text around a match runs on over other pieces and matches; a match and its gap have two characters at least
    pieces = CONTEXT_CHARS // 2
    back = f"ARRAY_JOIN(SLICE(z.c, GREATEST(1, i + 1 - {pieces}), LEAST(i, {pieces})), '')"
    ahead = f"ARRAY_JOIN(SLICE(z.f, i + 2, {pieces}), '')"
    one = (f"TRANSFORM(z.m, (x, i) -> NAMED_STRUCT('kind', {kind}, 'n', i, 'gap', LENGTH(z.g[i]), 'v', x, 'l',"
           f" IF(i = 0 OR LENGTH(z.g[i]) >= {CONTEXT_CHARS}, RIGHT(z.g[i], {CONTEXT_CHARS}),"
           f" RIGHT(CONCAT({back}, z.g[i]), {CONTEXT_CHARS})), 'r', IF(LENGTH(z.g[i + 1]) >= {CONTEXT_CHARS},"
           f" LEFT(z.g[i + 1], {CONTEXT_CHARS}), LEFT(CONCAT(z.g[i + 1], {ahead}), {CONTEXT_CHARS}))))")
    cut = f"TRANSFORM(y.m, (x, i) -> RIGHT(CONCAT(RIGHT(y.g[i], {CONTEXT_CHARS}), RIGHT(x, {CONTEXT_CHARS})), {CONTEXT_CHARS}))"
    behind = f"TRANSFORM(y.m, (x, i) -> LEFT(CONCAT(LEFT(x, {CONTEXT_CHARS}), LEFT(y.g[i + 1], {CONTEXT_CHARS})), {CONTEXT_CHARS}))"
    return (f"IF({MAY_HOLD[kind]}, TRANSFORM(ARRAY(REGEXP_EXTRACT_ALL(t, {p}, 0)), m -> IF(SIZE(m) = 0, {none},"
            f" TRANSFORM(TRANSFORM(ARRAY(NAMED_STRUCT('m', m, 'g', SPLIT(t, {p}, -1))), y ->"
            f" NAMED_STRUCT('m', y.m, 'g', y.g, 'c', {cut}, 'f', {behind})), z -> {one})[0]))[0], {none})")


def _clear(others: str, exempt: str) -> Column:
    """Whether a row is exempt or touches none of the others of its document, which are clear of each other."""
    before = Window.partitionBy("uid").orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("uid").orderBy(F.desc("s"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach, following = F.max(F.expr(f"IF({others}, e, NULL)")).over(before), F.min(F.expr(f"IF({others}, s, NULL)")).over(after)
    return F.expr(exempt) | (F.coalesce(reach <= F.col("s"), F.lit(True)) & F.coalesce(following >= F.col("e"), F.lit(True)))


def base_rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has uid and id of every input row; spans uid, kind, s, e, v, the word before (l), the patterns (p), mail and other.

    Kinds 0 to 3 are base spans that pass their checks; RUN and WORD are candidates outside all of these.  ``mail``
    and ``other`` tell whether the row is an instance for e-mail and for the other kinds."""
    hits = "CONCAT(" + ", ".join(_hits(k) for k in range(6)) + ")"
    raw = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").cast("bigint").alias("id"),
                      F.expr(f"COALESCE(`{text}`, '')").alias("t"))
    raw = stored(raw.select("uid", "id", F.expr(hits).alias("hits")), "pii-hits")
    found = raw.selectExpr("uid", "INLINE(hits)")
    upto = Window.partitionBy("uid", "kind").orderBy("n")
    found = found.withColumn("e", F.sum(F.expr("gap + LENGTH(v)")).over(upto)).withColumn("s", F.expr("e - LENGTH(v)"))
    found = found.withColumn("d", F.expr("REGEXP_REPLACE(v, '[^0-9]', '')"))
    passes = "CASE kind " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in PASSES.items()) + " ELSE TRUE END"
    # whole words without the signs that touch the match, numbers as one sign: the same for base spans and candidates
    words = "FILTER(SPLIT(REGEXP_REPLACE({}, '[0-9]+', '#'), '\\\\s+'), w -> w <> '')"
    sign = r"[^\\p{L}\\p{M}\\p{N}\\s]"
    before = f"REGEXP_REPLACE(LOWER(IF(LENGTH(l) < {CONTEXT_CHARS}, l, REGEXP_REPLACE(l, '^\\\\S++', ''))), '{sign}++\\\\z', '')"
    after = f"REGEXP_REPLACE(LOWER(IF(LENGTH(r) < {CONTEXT_CHARS}, r, REGEXP_REPLACE(r, '\\\\S++\\\\z', ''))), '^{sign}++', '')"
    found = found.where(passes).selectExpr("uid", "kind", "INT(s) AS s", "INT(e) AS e", "v", f"{words.format(before)} AS l",
                                           f"{words.format(after)} AS r")
    # candidates: without the signs around them, and clear of every base span of the document
    lead = r"LENGTH(REGEXP_EXTRACT(v, '^([^\\p{L}\\p{N}]*)', 1))"
    tail = r"LENGTH(REGEXP_EXTRACT(REVERSE(v), '^([^\\p{L}\\p{N}]*+)', 1))"
    found = found.selectExpr("uid", "kind", f"IF(kind >= {RUN}, s + {lead}, s) AS s", f"IF(kind >= {RUN}, e - {tail}, e) AS e",
                             f"IF(kind >= {RUN}, LOWER(SUBSTRING(v, 1 + {lead}, LENGTH(v) - {lead} - {tail})), LOWER(v)) AS v",
                             "TRY_ELEMENT_AT(l, -2) AS l2", "TRY_ELEMENT_AT(l, -1) AS l", "TRY_ELEMENT_AT(r, 1) AS r")
    found = found.withColumn("clear", _clear(f"kind < {RUN}", f"kind < {RUN}")).where("clear")
    found = found.withColumn("clear", _clear(f"kind = {RUN}", f"kind < {WORD}")).withColumn(
        "other", F.expr(f"clear AND (kind < {WORD} OR v RLIKE '[0-9]')"))
    shape = r"REGEXP_REPLACE(REGEXP_REPLACE(v, '[\\p{L}\\p{M}]+', 'a'), '[0-9]+', '9')"
    short = f"IF(LENGTH({{0}}) > {LONG_VALUE}, MD5({{0}}), {{0}})"
    patterns = ("FILTER(ARRAY(CONCAT('2 ', l2, ' ', l), CONCAT('m ', l, ' ', r), CONCAT('s ', l, ' ', "
                f"{short.format(shape)}), CONCAT('1 ', l)), p -> p IS NOT NULL)")
    return raw.select("uid", "id"), stored(found.selectExpr(
        "uid", "kind", "s", "e", f"{short.format('v')} AS v", "l", f"{patterns} AS p", f"kind <> {RUN} AS mail", "other"), "pii-spans")


def bootstrap(spans: DataFrame, rounds: int = ROUNDS, min_seeds: float = MIN_SEEDS,
              min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(p, kind, confidence): the accepted patterns, at most one kind each."""
    edges = spans.select("l", F.explode("p").alias("p"), "v", "mail", "other").groupBy("p", "l", "v").agg(
        F.max("mail").alias("mail"), F.max("other").alias("other"))
    edges = stored(edges, "pii-edges")
    sizes = stored(edges.groupBy("p").agg(F.count_if("mail").alias("n_mail"), F.count_if("other").alias("n_other")), "pii-patterns")
    can = "IF(kind = 0, mail, other)"
    seeds = stored(spans.where(f"kind < {RUN}").select("v", "kind").distinct().withColumn("w", F.lit(1.0)), "pii-seeds")
    # a pattern of one word is never easier to accept than a narrow one
    alone = F.col("p").startswith("1 ")
    least = F.when(alone, max(min_seeds, BACKED_OFF[0])).otherwise(min_seeds)
    sure = F.when(alone, max(min_confidence, BACKED_OFF[1])).otherwise(min_confidence)
    known, accepted = seeds, None
    for number in range(rounds):
        weight = edges.join(known, "v").where(can).groupBy("p", "kind").agg(F.sum("w").alias("w"))
        scored = weight.join(sizes, "p").withColumn("confidence", F.expr("w / (IF(kind = 0, n_mail, n_other) + 0.5)")).where(
            (F.col("w") >= least) & (F.col("confidence") >= sure))
        accepted = stored(scored.groupBy("p").agg(F.max(F.struct("confidence", F.expr("-kind AS k"))).alias("best")).selectExpr(
            "p", "-best.k AS kind", "best.confidence AS confidence"), "pii-accepted")
        if number + 1 < rounds:
            told = edges.join(accepted, "p").where(can).groupBy("v", "kind", "l").agg(F.max("confidence").alias("c"))
            told = told.groupBy("v", "kind").agg(F.expr("1 - EXP(SUM(LN(GREATEST(1 - c, 1e-9))))").alias("w"))
            best = told.groupBy("v").agg(F.max(F.struct("w", F.expr("-kind AS k"))).alias("b")).selectExpr(
                "v", "-b.k AS kind", "b.w AS w")
            known = stored(best.join(seeds.select("v"), "v", "left_anti").unionByName(seeds), "pii-known")
    return accepted


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans), n_added."""
    rows, spans = base_rows(docs, doc_id, text)
    patterns = bootstrap(spans).selectExpr("p", "kind AS told", "confidence")
    base = spans.where(f"kind < {RUN}").selectExpr("uid", "kind", "s", "e", "TRUE AS base")
    mentions = spans.where(f"kind >= {RUN} AND e > s").select("uid", "s", "e", "mail", "other", F.explode("p").alias("p"))
    told = mentions.join(patterns, "p").where("IF(told = 0, mail, other)").groupBy("uid", "s", "e").agg(
        F.max(F.struct("confidence", F.expr("-told AS k"))).alias("best"))
    added = told.selectExpr("uid", "-best.k AS kind", "s", "e", "FALSE AS base")
    lists = base.unionByName(added).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e", "base"))).alias("all"))
    names = "ELEMENT_AT(ARRAY('" + "', '".join(KINDS) + "'), x.kind + 1)"
    joined = f"CONCAT_WS(',', TRANSFORM({{}}, x -> CONCAT({names}, ':', x.s, ':', x.e)))"
    full = rows.join(lists, "uid", "left").withColumn("all", F.expr(
        "COALESCE(all, CAST(ARRAY() AS ARRAY<STRUCT<kind: INT, s: INT, e: INT, base: BOOLEAN>>))"))
    counts = [f"BIGINT(SIZE(FILTER(all, x -> x.base AND x.kind = {k}))) AS n_{name}" for k, name in enumerate(KINDS)]
    return full.selectExpr("id AS doc_id", *counts, f"SHA2({joined.format('FILTER(all, x -> x.base)')}, 256) AS base_sha256",
                           f"{joined.format('all')} AS spans", "BIGINT(SIZE(FILTER(all, x -> NOT x.base))) AS n_added")
