"""Quality by a byte-level convolutional network, in numpy.

A text's bytes are read in overlapping chunks that cover the whole document.  Filters of
``WIDTH`` bytes, learned as one weight per place and byte value, slide over every chunk; each
filter's largest answer in the chunk is kept (max pooling).  The mean and the maximum over
the chunks of the document feed one logistic output.

The network is trained on the driver on a bounded sample of labelled documents; scoring runs in
tasks over whole texts, a bounded number of chunks at a time.

Defined results: null and empty texts are one chunk of padding; a very long text gives all its chunks, a bounded number at a time; a null id is not held out and not
learnt from; if a document has several labels the smallest counts; without labels of both kinds
every score is 0.5; a score of exactly 0.5 is predicted 1; an empty table gives no rows; repeated rows get equal
results; other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import bounded_sample, excerpt, held_out

MOD, REMAINDER = 3, 1
MAX_EACH = 1200  # labelled documents of each kind fitted on, taken in the order of a hash of the id
MAX_CHARS = 40_000  # a longer training document gives a stretch of this length
CHUNK, OVERLAP, WIDTH, FILTERS = 512, 32, 5, 20
SLAB = 24  # chunks convolved at a time
TRAIN_CHUNKS = 5  # chunks of one training document seen in one epoch, drawn from all of it
EPOCHS = 8


def chunked(text: str | None) -> np.ndarray:
    """(chunks, CHUNK + WIDTH - 1) bytes; zero bytes pad the end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step, width = CHUNK - OVERLAP, CHUNK + WIDTH - 1
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + width, np.uint8)
    padded[: min(len(data), len(padded))] = data[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, width)[::step]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Largest filter answers of each chunk (and where they are)."""
        top, where = [], []
        for a in range(0, len(chunks), SLAB):
            part = chunks[a : a + SLAB]
            answer = np.take(self.filters[0], part[:, :CHUNK], axis=0)
            for j in range(1, WIDTH):
                answer += np.take(self.filters[j], part[:, j : j + CHUNK], axis=0)
            if places:
                at = answer.argmax(axis=1)
                where.append(at)
                top.append(np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0])
            else:
                top.append(answer.max(axis=1))
        best = np.tanh(np.concatenate(top) + self.bias)
        return (best, np.concatenate(where)) if places else best

    def probability(self, text: str | None) -> float:
        h = self.pooled(chunked(text))
        z = float(np.concatenate((h.mean(axis=0), h.max(axis=0))) @ self.out + self.shift[0])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def train(self, texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 6) -> None:
        """Adam on the log loss, with gradients through both poolings."""
        rng = np.random.default_rng(seed)
        docs = [chunked(t) for t in texts]
        params = [self.filters, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), 32):
                ids = order[a : a + 32]
                parts = [docs[i] if len(docs[i]) <= TRAIN_CHUNKS else docs[i][rng.choice(len(docs[i]), TRAIN_CHUNKS, False)]
                         for i in ids]
                x = np.concatenate(parts)
                owner = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                h, where = self.pooled(x, places=True)
                count = np.bincount(owner).astype(np.float32)
                mean = np.add.reduceat(h, first) / count[:, None]
                most = np.maximum.reduceat(h, first)
                z = np.hstack((mean, most))
                p = 1 / (1 + np.exp(-np.clip(z @ self.out + self.shift[0], -50, 50)))
                err = ((p - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
                dz = err[:, None] * self.out[None, :]
                dh = (dz[:, :FILTERS] / count[:, None])[owner] + dz[:, FILTERS:][owner] * (h == most[owner])
                da = dh * (1 - h * h)
                gf = np.zeros_like(self.filters)
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    np.add.at(gf[j], (np.take_along_axis(x, where + j, axis=1), f), da)
                grads = [gf, da.sum(axis=0), z.T @ err + 1e-4 * self.out, np.array([err.sum()], np.float32)]
                t += 1
                lr = rate * (1 - epoch / epochs * 0.8)
                for q, g, mm, vv in zip(params, grads, m, v):
                    mm *= 0.9
                    mm += 0.1 * g
                    vv *= 0.99
                    vv += 0.01 * g * g
                    q -= (lr * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH) -> Network:
    """Fit on at most ``max_each`` labelled documents of each kind, outside the held-out part.

    One text of each id comes to the driver, of several the smallest."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(f"NOT {held_out('doc_id', MOD, REMAINDER)}")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"))
    ids = bounded_sample(known, "y", "doc_id", max_each).select("doc_id", "y")
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(F.broadcast(ids), "doc_id").selectExpr(
        "doc_id", "y", f"{excerpt('text', 'doc_id', MAX_CHARS)} AS t").groupBy("doc_id", "y").agg(F.min("t").alias("t")).collect()
    rows = sorted((r.doc_id, r.y, r.t or "") for r in rows)
    y = np.array([r[1] for r in rows], np.float32)
    net = Network()
    if len(set(y.tolist())) == 2:
        net.train([r[2] for r in rows], y)
    return net


def scores(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([shared.value.probability(t.as_py()) for t in batch["t"]], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                       F.expr(held_out(doc_id, MOD, REMAINDER)).alias("held_out"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
