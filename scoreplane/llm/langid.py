"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with training text.  A text is
encoded in chunks with every dictionary; the language that encodes the whole text in the fewest bytes
wins.  The margin to the runner-up, in bytes per chunk encoded, must not be narrow for the
result to be accepted; the score is the winner's share under weights 2^(-saved bits per chunk).

The model is bounded: a language has at most EXCERPTS excerpts, and where there are so many languages that these
would exceed ALL_EXCERPTS, each has an equal share, one at least.  The number of languages itself is that of the
distinct non-null lang values, each of which is a class.

Every language keeps all its training text up to DICTIONARY_BYTES.  Shorter text is repeated to the length of the
longest dictionary, so that all are searched with the same parameters and distances cost the same.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
first language in order; a null id is not held out and not learnt from; without any training text all
are ``und``; a long text is encoded whole, a chunk at a time; an empty table gives no rows; repeated rows get equal
results; other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import bounded_sample, excerpt, held_out

MOD, REMAINDER = 4, 2
DICTIONARY_BYTES = 400_000  # training text held for each language
LEAST_BYTES = 8  # zstandard takes no shorter dictionary
EXCERPT_CHARS = 1024  # at most so much of one training document
EXCERPTS = 400  # training documents for each language, in the order of a digest of the id
ALL_EXCERPTS = 80_000  # training documents in all: what the driver collects and the tasks hold
CHUNK = 1024
LEVEL = 6
MARGIN = 0.02  # smallest accepted saving over the runner-up, as a share of the winner's bytes
LETTER = regex.compile(r"\p{L}")


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self.langs = sorted(dictionaries)
        self._ready: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.__init__(state)

    def filled(self, lang: str) -> bytes:
        """The language's dictionary, repeated to the length of the longest one."""
        size = max(LEAST_BYTES, *(len(v) for v in self.dictionaries.values()))
        own = self.dictionaries[lang]
        return own if len(own) == size else ((own + b"\n") * (size // (len(own) + 1) + 1))[-size:]

    def sizes(self, data: bytes) -> np.ndarray:
        """Bytes of the whole text under each language's dictionary."""
        if self._ready is None:
            self._ready = []
            for lang in self.langs:
                filled = self.filled(lang)
                params = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=CHUNK, dict_size=len(filled),
                    write_content_size=False, write_checksum=False, write_dict_id=False)
                content = zstandard.ZstdCompressionDict(filled, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(compression_params=params)
                self._ready.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))
        out = np.zeros(len(self.langs), np.int64)
        for a in range(0, len(data), CHUNK):
            part = data[a : a + CHUNK]
            for n, c in enumerate(self._ready):
                out[n] += len(c.compress(part))
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        data = text.lower().encode("utf-8", "surrogatepass")
        sizes = self.sizes(data)
        best = int(np.argmin(sizes))
        chunks = -(-len(data) // CHUNK)
        score = float(1 / np.exp2(-np.minimum(60, (sizes - sizes[best]) / chunks)).sum())
        rest = np.delete(sizes, best)
        margin = (rest.min() - sizes[best]) / sizes[best] if len(rest) else 1.0
        return self.langs[best], score, bool(margin >= MARGIN)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Dictionaries from at most EXCERPTS excerpts for each language, ALL_EXCERPTS in all, outside the held-out part.

    The excerpt of a training document starts at a place that depends on its id."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{lang}`").alias("lang"),
                       F.col(f"`{text}`").alias("t"), F.expr(held_out(doc_id, MOD, REMAINDER)).alias("out"))
    rows = rows.where("NOT out AND i IS NOT NULL AND lang IS NOT NULL AND t <> ''").select("lang", "i", "t")
    found = bounded_sample(rows, "lang", "i", EXCERPTS, in_all=ALL_EXCERPTS).selectExpr(
        "lang", "_rank AS n", f"{excerpt('t', 'i', EXCERPT_CHARS)} AS t").where("t RLIKE '\\\\p{L}'").collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        texts.setdefault(r.lang, []).append((r.n, r.t))
    joined = {k: "\n".join(t for _, t in sorted(v)).lower().encode("utf-8", "surrogatepass") for k, v in texts.items()}
    return Model({k: v[:DICTIONARY_BYTES] for k, v in joined.items()})


def predictions(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["t"].to_pylist()]
            columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *columns],
                                             names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                       F.expr(held_out(doc_id, MOD, REMAINDER)).alias("held_out"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
