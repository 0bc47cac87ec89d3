"""Ranked lexical search with range-maximum sparse tables per posting list.

**Index.** One map over the documents cuts them into shards of bounded size; a shard has a row per term (its documents by
place and how often they hold it) and a row that lists its documents (ids and numbers of terms).  Every document and
every term is indexed, whatever the searches; nothing is shuffled.

**Statistics.** N and L come from the shards' document lists, df of the searched terms from the lengths of their
posting lists; they give every searched term its weight.

**Search.** The posting lists of searched terms meet their shard's document list.  There every posting gets its impact,
and every list a sparse table of the places of its largest impacts over stretches of 1, 2, 4... postings, so the largest
impact in any interval of documents is two look-ups.  The sum of these over a search's terms bounds every document of the
interval.  Intervals are taken best first: the document with the largest single impact in it is scored exactly
and splits it in two, each bounded anew; intervals whose bound cannot enter the best ``top`` are left alone.  The
best of every shard meet in one ranking per item, cut to ``top`` rows map-side before the shuffle.

Items travel in blocks of at most ``BLOCK_CHARS`` characters (or one item), so the broadcasts are bounded and any number of
items is searched; a block's answer is written before the next one starts, and the index is made once.

Defined results: null texts have no terms and are never found; texts of any length are read whole, in runs; of equal scores
the smaller id comes first, a null id last; every row of documents and of items counts for itself, also where ids
repeat; items without any known term, and empty tables, give no rows; extra columns are never read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

TOP = 20
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_500_000
BLOCK_CHARS = 4_000_000
SHARDS_A_TASK = 16
TOGETHER = 64  # intervals taken from the queue at once
LONG_TEXT, PIECE = 1 << 22, 1 << 20
#: Letters, digits and all signs beyond ASCII.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: A term's row: its documents by place and how often each holds it; n is their number.  A shard's own row has no term:
#: docs tells whether the id is known, counts the documents' numbers of terms; n is the number of documents with terms.
INDEX = "shard string, term string, n bigint, total bigint, docs array<int>, counts array<bigint>, ids array<bigint>"


def _lowered(text: str) -> str:
    """The text with only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def terms(text: str | None) -> list[str]:
    return TERM.findall(_lowered(text or ""))


def term_counts(text: str | None) -> Counter[str]:
    """How often a whole text holds each term; a long text goes through in pieces cut between terms."""
    if len(text or "") < LONG_TEXT:
        return Counter(terms(text))
    counts, a = Counter(), 0
    while a < len(text):
        b = a + PIECE
        while 0 < b < len(text) and TERM.match(text, b - 1) and TERM.match(text, b):
            end = TERM.match(text, b).end()
            b = end if end < len(text) else len(text)
        counts.update(terms(text[a:b]))
        a = b
    return counts


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    posts: dict[str, tuple[list[int], list[int]]] = {}
    ids: list[int | None] = []
    lengths: list[int] = []
    postings = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        name = f"{part}-{made}"
        known = [int(i is not None) for i in ids]
        yield _rows([(name, None, sum(n > 0 for n in lengths), sum(lengths), known, lengths, [i or 0 for i in ids])])
        named = sorted(posts)
        for a in range(0, len(named), 20_000):
            yield _rows([(name, w, len(posts[w][0]), sum(posts[w][1]), *posts[w], None) for w in named[a : a + 20_000]])

    for batch in batches:
        for i, t in zip(batch["i"].to_pylist(), batch["t"]):
            counts = term_counts(t.as_py())
            for w, n in counts.items():
                if (post := posts.get(w)) is None:
                    post = posts[w] = ([], [])
                post[0].append(len(ids))
                post[1].append(n)
            ids.append(i)
            lengths.append(counts.total())
            postings += len(counts)
            if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield from flushed()
                posts, ids, lengths, postings, made = {}, [], [], 0, made + 1
    if ids:
        yield from flushed()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``, in the columns of ``INDEX``."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"))
    return stored(rows.mapInArrow(_shards, INDEX), "search-index")


class Lists:
    """The searched posting lists of one shard, end to end, with their sparse tables."""

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray], n_docs: int):
        """Each list has its documents in order."""
        self.n_docs = n_docs
        lengths = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        # one ascending key over all lists: (list, document)
        self.keys = np.repeat(np.arange(len(docs), dtype=np.int64), lengths) * n_docs + np.concatenate(docs)
        self.impacts = np.concatenate(impacts)
        self.tables, span, n = [np.arange(len(self.keys), dtype=np.int32)], 1, len(self.keys)
        while 2 * span <= lengths.max():  # a stretch that leaves its list is never asked for, so lists need no gaps
            left, right = self.tables[-1][: n - 2 * span + 1], self.tables[-1][span : n - span + 1]
            self.tables.append(np.where(self.impacts[left] >= self.impacts[right], left, right))
            span *= 2

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, place) of the largest posting in each stretch [a, b); impact 0 where it is empty."""
        width = b - a
        level = np.frexp(np.maximum(width, 1))[1] - 1
        best = np.zeros(a.shape, np.int64)
        for k in np.unique(level):
            at = (level == k) & (width > 0)
            left, right = self.tables[k][a[at]], self.tables[k][b[at] - (1 << int(k))]
            best[at] = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return np.where(width > 0, self.impacts[best], 0), best

    def search(self, lists: np.ndarray, repeats: np.ndarray, order: np.ndarray, top: int) -> list[tuple[int, int]]:
        """(score, document) of the best ``top`` documents for the lists, each counted so often; of equal scores the
        documents of smaller ``order`` are best."""
        a, b = self.starts[lists][None, :], self.starts[lists + 1][None, :]
        best: list[tuple[int, int, int]] = []  # (score, -order, document), the worst first
        queue: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        made = 0

        def push(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal made
            bounds = self.largest(a, b)[0] @ repeats
            worst = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(bounds >= worst):
                made += 1
                heappush(queue, (-int(bounds[i]), made, a[i], b[i]))

        push(a, b)
        while queue:
            taken = []
            while queue and len(taken) < TOGETHER:
                bound, _, a, b = heappop(queue)
                if len(best) == top and -bound < best[0][0]:
                    queue.clear()
                    break
                taken.append((a, b))
            if not taken:
                break
            a, b = np.stack([x for x, _ in taken]), np.stack([x for _, x in taken])
            impact, place = self.largest(a, b)
            pivot = (impact * repeats).argmax(axis=1)
            doc = self.keys[place[np.arange(len(taken)), pivot]] - lists[pivot] * self.n_docs
            wanted = lists[None, :] * self.n_docs + doc[:, None]
            middle = np.searchsorted(self.keys, wanted)
            held = (middle < b) & (self.keys[np.minimum(middle, len(self.keys) - 1)] == wanted)
            scores = np.where(held, self.impacts[np.minimum(middle, len(self.keys) - 1)], 0) @ repeats
            for score, d in zip(scores.tolist(), doc.tolist()):
                entry = (score, -int(order[d]), d)
                if score > 0 and len(best) < top:
                    heappush(best, entry)
                elif score > 0 and entry > best[0]:
                    heapreplace(best, entry)
            push(np.concatenate((a, middle + held)), np.concatenate((middle, b)))
        return [(s, d) for s, _, d in best]


def _searched(items, weights: dict[str, int], n_docs: int, n_terms: int, top: int):
    """Search of one shard: its document list and its searched posting lists come as one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        listed = rows["term"].isna().to_numpy()
        out: list[tuple[int, int | None, int]] = []
        lists = rows[~listed].sort_values("term")
        if listed.any() and len(lists):
            own = rows[listed].iloc[0]
            lengths = np.asarray(own["counts"], np.int64)
            ids, unknown = np.asarray(own["ids"], np.int64), np.asarray(own["docs"]) == 0
            spread = 12 * (75 + (25 * lengths * n_docs) // n_terms)
            docs = [np.asarray(d, np.int64) for d in lists["docs"]]
            counts = [np.asarray(c, np.int64) for c in lists["counts"]]
            impacts = [weights[w] * ((1_000_000_000 * c) // (1000 * c + spread[d]))
                       for w, d, c in zip(lists["term"], docs, counts)]
            table = Lists(docs, impacts, len(lengths))
            place = {w: i for i, w in enumerate(lists["term"])}
            order = np.empty(len(ids), np.int64)
            order[np.lexsort((ids, unknown))] = np.arange(len(ids))
            for item, held in items.value:
                known = [(place[w], n) for w, n in held if w in place]
                if known:
                    found = table.search(*(np.array(x, np.int64) for x in zip(*known)), order, top)
                    out += [(item, None if unknown[d] else int(ids[d]), s) for s, d in found]
        return pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    return run


def _item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """(row number, item id, (term, repeats) pairs) of every item, in blocks of bounded size."""
    block, size = [], 0
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t"))
    for number, r in enumerate(stored(rows, "items").toLocalIterator()):
        held = sorted(term_counts(r.t).items())
        if block and size + len(r.t or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((number, r.i, held))
        size += len(r.t or "")
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The best ``top`` documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    made = index(docs, doc_id, text)
    listed = made.where("term IS NULL")
    shards, n_docs, n_terms = listed.agg(F.count(F.lit(1)), F.sum("n"), F.sum("total")).first()
    # Spark would pack the shards by bytes; their work goes by postings
    tasks = max(shards // SHARDS_A_TASK, min(shards, 4 * spark.sparkContext.defaultParallelism), 1)
    kind = items.schema[item_id].dataType.simpleString()
    answers = []
    for block in _item_blocks(items, item_id, item_text, block_chars) if n_terms else ():
        wanted = F.broadcast(spark.createDataFrame([(w,) for w in sorted({w for _, _, held in block for w, _ in held})],
                                                   "term string"))
        df = made.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df")).selectExpr(
            "term", f"CAST(FLOOR(1000 * LN((2 * DOUBLE({n_docs}) + 2) / (2 * DOUBLE(df) + 1))) AS BIGINT) AS w")
        weights = {r.term: r.w for r in df.collect()}  # of the block's terms only
        shared = spark.sparkContext.broadcast([(number, held) for number, _, held in block])
        lists = made.join(wanted, "term", "left_semi").unionByName(listed).repartition(tasks, "shard")
        found = lists.groupBy("shard").applyInPandas(_searched(shared, weights, n_docs, n_terms, top),
                                                     "item bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        named = spark.createDataFrame([(number, i) for number, i, _ in block], f"item bigint, item_id {kind}")
        answers.append(stored(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.unpersist()
    if not answers:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, answers)
