"""Byte-level BPE encoding and decoding as a monoid, reduced over a tree.

An element is the encoding of a stretch of bytes.  A match of the split pattern is encoded by encoding its halves
and joining them; leaves of at most ``LEAF`` bytes are merged directly, lowest rank first, leftmost of equal ranks.

Joining: a sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of
their two together.  (Take the first merge in the whole that crosses an edge between two tokens: before it, the
merges around that edge were those of the two alone, so the two alone would merge across the edge as well.)
So only the edge between the halves needs work.  If the two tokens there are stable, the halves are laid end to
end.  Otherwise the window around the edge is encoded anew, and doubled on each side on which its last token
isn't stable beside the first token outside; tokens outside a stable edge provably stay.  Matches of the pattern are
encoded apart, so above them the join is plain concatenation.  Decoding concatenates the tokens' bytes, halves first.

Every document is one row of a map; nothing is shuffled.  The ranks (one vocabulary file) are the only broadcast,
bounded by ``MAX_VOCABULARY`` bytes.

Defined results: null texts count as empty, which have no tokens; texts of any length go through in runs of ``RUN``
matches, a single match of any length by the tree; repeated rows and null ids give a row each; an empty table gives an
empty result; extra columns are never read."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8  # bytes merged directly
RUN = 1 << 16  # matches of a long text in memory at once
LONG_TEXT = 1 << 20  # characters from which a text goes through in runs
KNOWN_MATCHES, KNOWN_CHARS = 500_000, 64  # encoded matches that a task remembers, and their longest
KNOWN_EDGES = KNOWN_LEAVES = 500_000
MAX_VOCABULARY = 256 << 20

# --- fixed values: letters and numbers newer than Unicode 16, which the public encoder's split does not know as such
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
_NEITHER = "\U0010ffff"  # neither letter, number nor white space


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a file of ``base64 rank`` lines."""
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Known(dict):
    """Packed ids of the matches seen so far; bounded, and filled by looking up."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, match: str) -> bytes:
        data = match.encode()
        rank = self.codec.ranks.get(data)
        packed = np.array(self.codec.encode_bytes(data) if rank is None else [rank], "<u4").tobytes()
        if len(match) <= KNOWN_CHARS:
            if len(self) >= KNOWN_MATCHES:
                self.clear()
            self[match] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.pattern = ranks, pattern
        self.split = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known, self.edges, self.leaves = _Known(self), {}, {}

    def __reduce__(self):
        return Codec, (self.ranks, self.pattern)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a stretch, by merging its neighbours of lowest rank until none is left."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the token that starts here; 0 where none starts
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has merged otherwise
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, left: int, right: int) -> bool:
        """Whether two neighbours are the encoding of their bytes together."""
        edge = (left, right)
        if (known := self.edges.get(edge)) is None:
            if len(self.edges) >= KNOWN_EDGES:
                self.edges.clear()
            known = self.edges[edge] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two stretches end to end, from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1  # tokens of each side in the window
        while True:
            window = self.merged(self.decode([*left[len(left) - i :], *right[:j]]))
            more_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            more_right = j < len(right) and not self.stable(window[-1], right[j])
            if not more_left and not more_right:
                return left[: len(left) - i] + window + right[j:]
            i = min(len(left), 2 * i) if more_left else i
            j = min(len(right), 2 * j) if more_right else j

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tokens of one match, by the tree.  The left half ends at a power of two, so equal halves recur."""
        if len(data) <= LEAF:
            if (known := self.leaves.get(data)) is None:
                if len(self.leaves) >= KNOWN_LEAVES:
                    self.leaves.clear()
                known = self.leaves[data] = self.merged(data)
            return known
        half = 1 << (len(data) - 1).bit_length() - 1
        return self.joined(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def matches(self, text: str) -> Iterator[list[str]]:
        """The matches of the split pattern, in runs."""
        seen = text
        try:
            text.encode("latin-1")  # the common case, told fast
        except UnicodeEncodeError:
            seen = _NEWER.sub(_NEITHER, text)
        if seen == text and len(text) < LONG_TEXT:
            yield self.split.findall(text)
            return
        found = self.split.finditer(seen)
        while run := [text[m.start() : m.end()] for m in islice(found, RUN)]:
            yield run

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        packed = [b"".join(map(self.known.__getitem__, run)) for run in self.matches(text or "")]
        return np.frombuffer(packed[0] if len(packed) == 1 else b"".join(packed), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a sequence of ids, halves first."""
        if len(ids) <= RUN:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _mapped(docs: DataFrame, codec: Codec, doc_id: str, value: str, schema: str, answer) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                answers = [answer(shared.value, v.as_py()) for v in part["v"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, zip(*answers), kinds)],
                                                 names=["doc_id", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
             [c.split()[1]] for c in schema.split(", ")]
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{value}`").alias("v"))
    return rows.mapInArrow(run, f"doc_id bigint, {schema}")


def encoded(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    return _mapped(docs, codec, doc_id, text, "ids array<bigint>", lambda c, t: (c.encode(t).tolist(),))


def decoded(rows: DataFrame, codec: Codec, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, data) of every row: the bytes of its ids; null ids give none."""
    return _mapped(rows, codec, doc_id, ids, "data binary", lambda c, i: (c.decode(i or []),))


def _round_trip(codec: Codec, text: str | None) -> tuple[int, str, str]:
    ids = codec.encode(text)
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids.tolist())).hexdigest()


def round_trips(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, the digest of its ids, and that of the bytes decoded from them."""
    return _mapped(docs, codec, doc_id, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _round_trip)
