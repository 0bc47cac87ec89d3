"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Texts with the same shingle set form one class.  Each class has ``TREES`` labels of ``FULL_DEPTH`` MinHash values,
one path in each tree.  A pair of similarity s shares a prefix of length d in some tree with probability
1 - (1 - s^d)^TREES.  Prefixes are shortened from the full label until that reaches the target recall at the
threshold (3 values for 0.8 and 0.9999); the members of such a prefix are one node.  Which trees are
shortened must not depend on who is met there: keeping crowded nodes at longer prefixes would spare just the
trees in which the partners are, so the length is the same in all trees.  What a short prefix admits too much,
the rest of the labels takes back: of all values of both labels, at least ``agreement`` must be equal, a count
that a pair at the threshold misses with a hundredth of the recall's allowance.

Candidates are verified on whole shingle sets, in blocks: a node of any size is dealt
into chunks of bounded size and every pair of chunks is a small task of its own, so a node that holds a third of
all classes neither meets in one task nor is cut.  A pair that meets in several trees is
verified in the first of them only, and only classes with such a pair travel with their sets.  Tasks are dealt by
a number of rows, not of bytes, so that they stay alike in size whatever the input.  A block reports
link counts per class and a spanning forest, never its pairs.

Defined results: words are lower-cased runs between ASCII white space; a text of fewer than
five words is one shingle, a null or empty text the empty one (all such form one class); very long texts
are read whole, in steps; nulls in other columns and clashing names are never read; copies count as links, also
rows equal in all columns; of rows equal in id and text the one whose other columns are largest stays; an empty table
gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import batched, pack, row_key, stored
from scoreplane.llm.components import components
from scoreplane.llm.shingles import digest, minhash, shingle_set

THRESHOLD = 0.8
TARGET_RECALL = 0.9999
TREES = 16
FULL_DEPTH = 6
CHUNK = 512
#: Rows of one task: members with their labels, and members with their whole sets.
LABEL_ROWS, SET_ROWS = 4096, 2048
NODE = ["t", "h", "lo", "hi"]


def matched_depth(threshold: float, target: float, trees: int, full: int) -> int:
    """The longest prefix at which a pair at the threshold meets with the target probability."""
    for depth in range(full, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    raise ValueError("no prefix length reaches the target recall; use more trees")


def agreement(threshold: float, target: float, values: int) -> int:
    """The largest number of equal values that a pair at the threshold reaches but for (1 - target) / 100."""
    missed = 0.0
    for n in range(values + 1):
        missed += math.comb(values, n) * threshold**n * (1 - threshold) ** (values - n)
        if missed > (1 - target) / 100:
            return n
    return values


def signatures(docs: DataFrame, doc_id: str, text: str, trees: int) -> DataFrame:
    """(k, id, c, labels) for every row: its key, id, class (digest of the shingle set) and the labels of all trees."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for k, i, known, t in zip(batch["k"], batch["i"], batch["known"], batch["t"]):
                    s = shingle_set(t)
                    yield k, int(i) if known else None, digest(s), minhash(s, trees * FULL_DEPTH).tobytes()

        for out in batched(rows(), ["k", "id", "c", "labels"], 1024):
            yield out.astype({"id": "Int64"})

    rows = pack(docs, k=row_key(doc_id, text), i=f"COALESCE(CAST(`{doc_id}` AS BIGINT), 0)",
                known=f"`{doc_id}` IS NOT NULL", t=f"`{text}`")
    return rows.mapInPandas(sign, "k string, id bigint, c string, labels binary")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(node, columns) of every block of two or more rows; the rows of a block lie together, one block is held."""
    parts: list[dict[str, np.ndarray]] = []
    current: tuple | None = None

    def whole() -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
        if sum(len(p["cid"]) for p in parts) > 1:
            yield current, parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for batch in batches:
        if not len(batch):
            continue
        cols = {c: batch[c].to_numpy() for c in batch.columns}
        change = np.ones(len(batch), bool)
        change[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in NODE])
        starts = [*change.nonzero()[0].tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            key = tuple(int(cols[c][a]) for c in NODE)
            if key != current:
                yield from whole()
                parts, current = [], key
            parts.append({c: v[a:b] for c, v in cols.items()})
    yield from whole()


def _open_pairs(key: tuple, rows: dict[str, np.ndarray], trees: int, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that meet in its tree and in no earlier one, each once, with labels alike enough."""
    t, _, lo, hi = key
    labels = np.frombuffer(b"".join(rows["labels"]), np.uint16).reshape(-1, trees, FULL_DEPTH)
    side = rows["side"]
    if len(labels) == 2:  # most blocks
        same = labels[0] == labels[1]
        met = same[:, :depth].all(axis=1)
        use = (lo == hi or side[0] != side[1]) and met[t] and not met[:t].any() and same.sum() >= least
        pair = np.arange(2) if use else np.empty(0, np.int64)
        return pair[:1], pair[1:]

    def meet(u: int) -> np.ndarray:
        return np.logical_and.reduce([labels[:, u, j][:, None] == labels[:, u, j][None, :] for j in range(depth)])

    mask = np.triu(meet(t), 1)
    if lo != hi:
        mask &= side[:, None] != side[None, :]
    for u in range(t):
        mask &= ~meet(u)
    left, right = mask.nonzero()
    alike = np.concatenate([np.zeros(0, bool)] + [
        (labels[left[a : a + 65536]] == labels[right[a : a + 65536]]).sum(axis=(1, 2)) >= least
        for a in range(0, len(left), 65536)])
    return left[alike], right[alike]


def _needed(trees: int, depth: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out():
            for key, rows in _blocks(batches):
                left, right = _open_pairs(key, rows, trees, depth, least)
                for n in np.unique(np.concatenate((left, right))):
                    yield *key, rows["cid"][n], rows["side"][n]

        yield from batched(out(), [*NODE, "cid", "side"])

    return run


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    if len(left) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1  # a shingle of one set alone is in no intersection
    column = (np.cumsum(shared) - 1)[inverse]
    use = shared[inverse]
    owner, column = owner[use], column[use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = 2048
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        cell = np.zeros((len(sets), step), np.float32)
        cell[owner[lo:hi], column[lo:hi] - a] = 1
        total += cell @ cell.T  # counts below 2^24 are exact
    return total[left, right].astype(np.int64)


def _verify(threshold: float, trees: int, depth: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out():
            for key, rows in _blocks(batches):
                left, right = _open_pairs(key, rows, trees, depth, least)
                sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
                sizes = np.array([len(s) for s in sets])
                able = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right]) - 1e-9
                left, right = left[able], right[able]
                if not len(left):
                    continue
                both = intersections(sets, left, right)
                linked = both / (sizes[left] + sizes[right] - both) >= threshold
                left, right = left[linked], right[linked]
                cid, mult = rows["cid"], rows["mult"]
                links = np.bincount(left, mult[right], len(cid)) + np.bincount(right, mult[left], len(cid))
                label = np.arange(len(cid))
                while True:  # smallest index in reach
                    low = label.copy()
                    np.minimum.at(low, left, label[right])
                    np.minimum.at(low, right, label[left])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                for i in np.unique(np.concatenate((left, right))):
                    yield cid[i], int(links[i]), cid[label[i]]

        yield from batched(out(), ["cid", "links", "root"])

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def out():
        for batch in batches:
            for cid, mult, labels, t in zip(batch["cid"], batch["mult"], batch["labels"], batch["t"]):
                yield cid, mult, labels, shingle_set(t).tobytes()

    yield from batched(out(), ["cid", "mult", "labels", "members"], 512)


def _dealt(rows: DataFrame, count: int, a_task: int) -> DataFrame:
    return rows.repartition(max(1, -(-count // a_task)), *NODE).sortWithinPartitions(*NODE, "cid")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                target_recall: float = TARGET_RECALL, trees: int = TREES, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: k, id, class_id, n_links, group_size, kept.

    class_id is the largest id of the group (connected by links); n_links counts the other
    rows of similarity ``threshold`` or more, copies included; kept marks the row of each group that stays."""
    depth = matched_depth(threshold, target_recall, trees, FULL_DEPTH)
    least = agreement(threshold, target_recall, trees * FULL_DEPTH)
    sigs = stored(signatures(docs, doc_id, text, trees), "signatures")
    classes = stored(sigs.groupBy("c").agg(F.max(F.struct("id", "k")).alias("rep"), F.count(F.lit(1)).alias("mult"),
                                           F.first("labels").alias("labels"))
                     .select("c", "rep", "mult", "labels", F.monotonically_increasing_id().alias("cid")), "classes")
    posts = classes.selectExpr("cid", "labels", f"EXPLODE(SEQUENCE(0, {trees - 1})) AS t").selectExpr(
        "cid", "t", f"XXHASH64(SUBSTRING(labels, {2 * FULL_DEPTH} * t + 1, {2 * depth})) AS h")
    nodes = stored(posts.groupBy("t", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").selectExpr(
        "t", "h", "m", f"INT((m + {chunk - 1}) DIV {chunk}) AS parts"), "nodes")
    met_rows = nodes.agg(F.sum(F.expr("m * parts"))).first()[0] or 0
    members = posts.join(nodes, ["t", "h"]).selectExpr("cid", "t", "h", "parts", "INT(PMOD(XXHASH64(cid), parts)) AS own").selectExpr(
        "cid", "t", "h", "own", "EXPLODE(SEQUENCE(0, parts - 1)) AS other")
    members = members.selectExpr("cid", "t", "h", "LEAST(own, other) AS lo", "GREATEST(own, other) AS hi",
                                 "INT(own > other) AS side")
    met = _dealt(members.join(classes.select("cid", "labels"), "cid"), met_rows, LABEL_ROWS)
    needed = stored(met.select(*NODE, "cid", "side", "labels").mapInPandas(
        _needed(trees, depth, least), "t int, h bigint, lo int, hi int, cid bigint, side int"), "candidates")

    wanted = needed.select("cid").distinct().join(classes, "cid").selectExpr("rep.k AS k", "cid", "mult", "labels")
    texts = pack(docs, k=row_key(doc_id, text), t=f"`{text}`").join(wanted.hint("merge"), "k")
    sets = texts.select("cid", "mult", "labels", "t").mapInPandas(
        _sets, "cid bigint, mult bigint, labels binary, members binary").dropDuplicates(["cid"])
    found = stored(_dealt(needed.join(sets, "cid"), needed.count(), SET_ROWS).select(
        *NODE, "cid", "side", "mult", "labels", "members").mapInPandas(
        _verify(threshold, trees, depth, least), "cid bigint, links bigint, root bigint"), "links")

    labels = components(found.selectExpr("cid AS a", "root AS b"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = classes.select("c", "cid", "rep", "mult").join(links, "cid", "left").join(
        labels.withColumnRenamed("node", "cid"), "cid", "left").selectExpr(
        "c", "cid", "rep", "mult", "COALESCE(label, cid) AS label", "COALESCE(links, 0) + mult - 1 AS n_links")
    linked = stored(linked, "linked")
    groups = linked.groupBy("label").agg(F.max("rep").alias("stays"), F.sum("mult").alias("group_size"))
    facts = linked.join(groups, "label").select("c", "n_links", "group_size", "stays")
    return sigs.join(facts, "c").selectExpr("k", "id", "stays.id AS class_id", "n_links", "group_size",
                                            "k = stays.k AS kept")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, all columns as they came.

    Of rows equal in id and text, the one whose other columns are largest stays."""
    kept = near_groups(docs, doc_id, text, **options).where("kept").select("k")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.expr(row_key(doc_id, text)).alias("k"))
    return rows.join(kept.hint("merge"), "k", "left_semi").groupBy("k").agg(F.max("row").alias("row")).select("row.*")
