"""Spelling variant grouping by reduced-alphabet generation.

**Words** are counted inside the tasks first (a table of bounded size that is handed on when full), so a very common word
is one row a task when it is shuffled.

**Reduced words.** Every letter becomes one of ``SYMBOLS`` symbols.  The full one-edit neighbourhood of a reduced word
(itself, all deletions, replacements and insertions of a symbol) holds the reduced form of every word at one edit.
Reduced words are named by a 64-bit polynomial hash, so a neighbour's name follows from the word's by one sum, whatever
the word's length, and its text is never made; equal reduced words have equal names, so none is missed.

**Join.** Neighbours meet the names of the reduced vocabulary by an equi-join; what meets is verified on the original
strings in the join itself (Levenshtein distance 1), so unverified pairs are never written.  Before, neighbours are
looked up in a bitmap of the names: it drops nothing that could meet, and its size is bounded (``MAX_BITS``);
beyond that size more neighbours travel to the join and the result is the same.

**Forms and roots.** A word's form is taken by one aggregation; forms at least double the count, so chains are short
and end.  Roots follow by pointer jumping over written tables.

Defined results: null texts have no words; a null id counts as an empty text before the colon; texts of any length are
counted whole, in pieces cut between runs; words longer than ``LONG_WORD`` travel by number instead of as text; every row
counts, also repeated ones; of near words of equal count the smallest in code-point order is the form; an empty table gives an
empty result; extra columns are never read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, ONE_IN = 5, 3, 97
SYMBOLS = 8
#: Letters from common to rare: dealt out in turn, every symbol gets a like share of a text.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
HELD_WORDS = 300_000  # words a task counts before it hands them on
LONG_TEXT, PIECE = 1 << 22, 1 << 20
LONG_WORD = 64
BITS_A_WORD, MAX_BITS = 32, 1 << 28
CELLS = 1 << 20  # neighbours made at once

_CODES = np.array([LETTERS.find(chr(c)) % SYMBOLS if chr(c) in LETTERS else c % SYMBOLS for c in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUES = np.random.default_rng(11).integers(1, 2**63, SYMBOLS, dtype=np.uint64)


def runs(text: str) -> list[str]:
    """The maximal runs of letters, with only A-Z lower-cased."""
    return RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def run_counts(text: str | None) -> Counter[str]:
    """The runs of a whole text; a long text goes through in pieces cut between runs."""
    if len(text or "") < LONG_TEXT:
        return Counter(runs(text or ""))
    counts, a = Counter(), 0
    while a < len(text):
        b = a + PIECE
        if b < len(text) and RUN.match(text, b - 1) and (m := RUN.match(text, b)):
            b = m.end()
        counts.update(runs(text[a:b]))
        a = b
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    names = ["word", "n"]
    for batch in batches:
        for i, t in zip(batch["i"].to_pylist(), batch["t"]):
            start = zlib.crc32(f"{'' if i is None else i}:".encode())
            for run, n in run_counts(t.as_py()).items():
                if len(run) < LEAST_CHARS:
                    continue
                h = zlib.crc32(run.encode(), start)
                if h % ONE_IN == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_CHARS:
                        continue
                held[run] += n
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys()), pa.array(held.values())], names=names)
                held = Counter()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held.keys()), pa.array(held.values())], names=names)


def _mix(x: np.ndarray, length: int) -> np.ndarray:
    x = x + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))


def _values(words: list[str]) -> np.ndarray:
    """The symbols' values of words of one length, a row a word."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return _VALUES[_CODES[codes]]


def names(words: list[str]) -> np.ndarray:
    """The names of the reduced forms of words of one length."""
    v = _values(words)
    return _mix((v * _powers(v.shape[1])[:-1]).sum(axis=1, dtype=np.uint64), v.shape[1])


def neighbours(words: list[str]) -> Iterator[np.ndarray]:
    """The names of the full one-edit neighbourhoods of the reduced words (of one length), a row a word, in blocks of places."""
    v = _values(words)
    n = v.shape[1]
    p = _powers(n)
    upto = np.concatenate((np.zeros((len(v), 1), np.uint64), np.cumsum(v * p[:-1], axis=1, dtype=np.uint64)), axis=1)
    whole = upto[:, -1:]
    yield _mix(whole, n)
    step = max(1, CELLS // (len(v) * (2 * SYMBOLS + 1)))
    for a in range(0, n + 1, step):
        b = min(n, a + step)
        without = whole - upto[:, a + 1 : b + 1]
        made = [_mix(upto[:, a:b] + without * _INVERSE, n - 1)]
        for s in _VALUES:
            made.append(_mix(whole + (s - v[:, a:b]) * p[a:b], n))
            c = min(n + 1, a + step)
            made.append(_mix(upto[:, a:c] + s * p[a:c] + (whole - upto[:, a:c]) * np.uint64(_BASE), n + 1))
        yield np.concatenate(made, axis=1)


def _by_length(words: list[str], cells: int = CELLS) -> Iterator[np.ndarray]:
    """Places of words of one length, few enough together for one block."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        most = max(1, cells // (int(n) * (2 * SYMBOLS + 1)))
        for a in range(0, len(at), most):
            yield at[a : a + most]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch["word"].to_pylist()
        h = np.zeros(len(words), np.uint64)
        for at in _by_length(words):
            h[at] = names([words[i] for i in at])
        yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(h.view(np.int64))], names=["word", "n", "h"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored words: wid, word, n, h (the name of the reduced word)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"))
    counts = rows.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    kept = stored(counts.where(F.col("n") >= LEAST_COUNT).mapInArrow(_named, "word string, n bigint, h bigint"), "named")
    return stored(kept.select(F.monotonically_increasing_id().alias("wid"), "word", "n", "h"), "vocabulary")


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def bitmap(words: DataFrame) -> np.ndarray:
    """Two bits a reduced word, in at most ``MAX_BITS`` bits; made by one aggregation over 64-bit cells."""
    bits = min(MAX_BITS, 1 << max(12, (BITS_A_WORD * max(1, words.count()) - 1).bit_length()))
    cells = words.selectExpr(f"EXPLODE(ARRAY(h & {bits - 1}L, SHIFTRIGHTUNSIGNED(h, 32) & {bits - 1}L)) AS s").groupBy(
        F.expr("s DIV 64 AS cell")).agg(F.expr("BIT_OR(SHIFTLEFT(1L, INT(s % 64))) AS held"))
    out = np.zeros(bits // 64, np.uint64)
    told = cells.toArrow()
    out[told["cell"].to_numpy()] = told["held"].to_numpy().view(np.uint64)
    return out


def _visits(held, long: bool):
    def known(h: np.ndarray) -> np.ndarray:
        table = held.value
        one, two = _slots(h, len(table) * 64)
        six, low = np.uint64(6), np.uint64(63)
        mask = (table[one >> six] >> (one & low)) & np.uint64(1) == 1
        mask[mask] = (table[two[mask] >> six] >> (two[mask] & low)) & np.uint64(1) == 1
        return mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, wid = batch["word"].to_pylist(), batch["wid"].to_numpy()
            for at in _by_length(words):
                seen = []
                for h in neighbours([words[i] for i in at]):
                    mask = known(h)
                    seen.append((np.nonzero(mask)[0], h[mask]))
                owner, h = (np.concatenate(x) for x in zip(*seen))
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
                owner, h = at[owner[first]], h[first].view(np.int64)
                for a in range(0, len(h), 100_000):
                    part = owner[a : a + 100_000]
                    text = pa.nulls(len(part), pa.string()) if long else batch["word"].take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000]), pa.array(wid[part]), text],
                                                     names=["h", "uid", "u"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(uid, v, n): every word's near words with their counts."""
    held = words.sparkSession.sparkContext.broadcast(bitmap(words))
    known = words.select("h", F.col("word").alias("v"), "n")
    told = words.select("wid", "word")

    def visits(kept: str, long: bool) -> DataFrame:
        return told.where(kept).mapInArrow(_visits(held, long), "h bigint, uid bigint, u string")

    short = visits(f"LENGTH(word) <= {LONG_WORD}", False).join(known, "h").where("LEVENSHTEIN(u, v, 1) = 1")
    long = visits(f"LENGTH(word) > {LONG_WORD}", True).join(known, "h").select("uid", "v", "n").join(
        told.withColumnRenamed("wid", "uid"), "uid").where("LEVENSHTEIN(word, v, 1) = 1")
    return short.select("uid", "v", "n").unionByName(long.select("uid", "v", "n"))


def forms(words: DataFrame) -> DataFrame:
    """Every word with n, n_near, form and form_n."""
    best = near_words(words).groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "v")).alias("best"))
    return words.join(best, words["wid"] == best["uid"], "left").selectExpr(
        "word", "n", "COALESCE(n_near, 0L) AS n_near", "IF(-best.less >= 2 * n, best.v, NULL) AS form",
        "IF(-best.less >= 2 * n, -best.less, NULL) AS form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by pointer jumping."""
    hops = stored(formed.where("form IS NOT NULL").selectExpr("word", "form AS root", "FALSE AS moved"), "hops")
    while True:
        onward = hops.selectExpr("word AS root", "root AS onward")
        hops = stored(hops.join(onward, "root", "left").selectExpr(
            "word", "COALESCE(onward, root) AS root", "onward IS NOT NULL AS moved"), "hops")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    formed = stored(forms(vocabulary(docs, doc_id, text)), "forms")
    return formed.join(roots(formed), "word", "left").selectExpr(
        "word", "form", "COALESCE(root, word) AS root", "n", "n_near", "form_n")
