"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to e = floor(rate * m) edits.  Cut into e + 1
pieces, at least one piece of such an occurrence is untouched, so the exact hits of all
pieces (one Aho-Corasick pass over the whole text) point at every place that can match.  The
surroundings of the hits are verified with Myers' bit-parallel edit distance.

Items go out in blocks of bounded size, one pass over the documents for each block.  With several blocks each
pass's result is written before the next block is read, so the driver and a task hold one block at a
time, and a test set of any size is searched whole with bounded memory.

Both sides are compared as lower-cased runs of letters and digits with one blank between.
Defined results: null or empty texts and items without a letter or digit match nothing; an
item too short for an edit must occur as whole words; equal items match each under its own
id; repeated rows each get their matches; a very long text is searched whole; a null item or document id is passed on as null; empty tables give empty results;
all other columns pass through untouched."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

RATE = 0.08
BLOCK_CHARS = 4_000_000
NORMAL = r"TRIM(REGEXP_REPLACE(LOWER(COALESCE(`{}`, '')), '[^\\p{{L}}\\p{{N}}]+', ' '))"

Item = tuple[int | None, str]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` within ``most`` edits, the earliest of equals."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if best <= most else None


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[Item], rate: float):
        self.items = items
        self.budget = [int(rate * len(text)) for _, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            e = self.budget[n]
            if not e:
                places.setdefault(f" {text} ", []).append((n, -1))
                continue
            cuts = [len(text) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item id, distance, end) for each item that occurs; ends count in the normalised text."""
        if not text or not self.items:
            return
        spans: dict[int, list[tuple[int, int]]] = {}
        done: dict[int, tuple[int, int]] = {}
        for last, (length, at) in self.automaton.iter(f" {text} "):
            begin = last - length  # in the text without the leading blank
            for n, offset in at:
                if n in done:
                    continue
                whole = self.items[n][1]
                start = begin - offset
                if start >= 0 and text.startswith(whole, start):
                    done[n] = (0, start + len(whole))
                else:
                    e = self.budget[n]
                    spans.setdefault(n, []).append((max(0, start - e), start + len(whole) + e))
        for n in sorted(spans.keys() - done.keys()):
            best = None
            for a, b in _merged(spans[n]):
                hit = myers(self.items[n][1], text[a:b], self.budget[n])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], hit[1] + a)
            if best:
                done[n] = best
        for n, (distance, end) in sorted(done.items()):
            yield self.items[n][0], distance, end

    def any(self, text: str) -> bool:
        return next(self.find(text), None) is not None


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    spans = sorted(set(spans))
    a, b = spans[0]
    for c, d in spans[1:]:
        if c <= b:
            b = max(b, d)
        else:
            yield a, b
            a, b = c, d
    yield a, b


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[tuple[list[Item], bool]]:
    """The normalised items in blocks of about ``block_chars`` characters, and whether there are several."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.expr(NORMAL.format(text)).alias("t")).where(
        "t <> ''")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for n in range(blocks):
        yield [tuple(r) for r in items.where(f"PMOD(XXHASH64(i, t), {blocks}) = {n}").orderBy("i", "t").collect()], blocks > 1


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item that occurs in it: doc_id, item_id, distance, match_end."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.expr(NORMAL.format(text)).alias("t")).where("t <> ''")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("match_end", pa.int32())])
    out = None
    for items, several in item_blocks(benchmark, item_id, item_text, block_chars):

        def search(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                found = [(i, *hit) for i, t in zip(batch["i"].to_pylist(), batch["t"].to_pylist()) for hit in matcher.find(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in found], schema.field(c).type) for c in range(4)], schema=schema)

        part = rows.mapInArrow(search, "doc_id bigint, item_id bigint, distance int, match_end int")
        if several:
            part = stored(part, "decontaminate-matches")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.where("FALSE").selectExpr("i AS doc_id", "i AS item_id", "0 AS distance", "0 AS match_end")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, all columns as they came; no shuffle."""
    columns, schema = docs.columns, docs.schema
    for items, several in item_blocks(benchmark, item_id, item_text, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                free = pa.array([not matcher.any(t) for t in batch["normal"].to_pylist()], pa.bool_())
                yield batch.select(["row"]).filter(free)

        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                             F.expr(NORMAL.format(text)).alias("normal"))
        row = "row struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema) + ">"
        docs = packed.mapInArrow(keep, row).select("row.*")
        if several:
            docs = stored(docs, "decontaminate-clean")
    return docs
