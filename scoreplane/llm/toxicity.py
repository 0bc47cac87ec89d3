"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts common subsequences of three characters inside words, spread over at most
``SPAN`` characters, each weighted by ``DECAY`` to the power of its spread, and is normalised, so a word with a
gap or an inserted character stays close to the word itself.  Words are lower-cased, their
look-alike signs mapped to letters, punctuation inside dropped, and runs of single letters joined.

Training (bounded samples of labelled documents, cut into sentences): every sentence of a clean
document is clean; a toxic document holds some toxic sentence, and which words make it so is
found by turns (witnesses).  The kernel against the landmarks gives Nyström features, on which a linear SVM is
fitted.  The SVM's weights fold back into one weight per subsequence, so scoring a word
is a few table look-ups and a document costs one pass over its whole text.  A document
scores as its worst sentences do, mapped to a probability on the training documents.

Defined results: null and empty texts have no words and get the score of a document without
any toxic word; a null id is not held out and not learnt from; if a document has several
labels the largest counts; repeated rows are scored alike, and a repeated id is learnt from once; texts of any length are
scored whole, and words beyond what training has seen do not dilute an insult; without labels of both kinds
every score is 0; an empty table gives an empty result; other columns are never read."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import bounded_sample, excerpt, held_out

MOD, REMAINDER = 4, 2
MAX_TOXIC, MAX_CLEAN = 1500, 3000  # labelled documents fitted on, taken in the order of a hash of the id
MAX_CHARS = 40_000  # a longer clean training document gives a stretch of this length; a longer toxic one is not learnt from
STEP = 20_000  # kernel terms multiplied at once
LANDMARKS = 256
SPAN, DECAY = 5, 0.5
ACCEPT = 0.3
CACHE = 200_000
NEGATIVES = 6_000  # words of clean documents that the SVM sees: so many frequent, impure and look-alike ones each
SURPRISE = 5.5  # standard deviations above chance from which a word is a first witness
PURITY = 0.98  # share of a first witness's rate that lies in toxic documents
SURE, LATER = 0.5, 0.5  # SVM score from which a word that no clean document has is a later witness; its margin
BENT = 0.05  # weight of the first witnesses' variants with an inserted character
REG = 1e-6
LONGEST = 0.99  # quantile of the training documents' numbers of distinct words beyond which more words do not count
LOWEST, HIGHEST = -1.5, 2.0  # word scores beyond say nothing more about the document

#: Look-alike signs inside words.
SIGNS = str.maketrans("0134579@$!", "oieastgasi")
EDGE = "%$&#*!?.,;:|()[]{}\"'-_"
SENTENCE = re.compile(r"[.!?\n]+")
SPACED = re.compile(r"(?<!\w)(?:\w[^\w\n]{1,2}){2,}\w(?!\w)")
ALPHABET = 64
PIECE, OVERLAP = 1 << 20, 200
GAPS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]


def pieces(text: str | None) -> Iterator[str]:
    """The lower-cased text in overlapping pieces of bounded length, cut between words where there is a gap."""
    text, a = (text or "").lower(), 0
    while a < len(text):
        b = min(len(text), a + PIECE)
        if b < len(text):
            gap = max(text.rfind(" ", a + PIECE // 2, b), text.rfind("\n", a + PIECE // 2, b))
            b = gap if gap > 0 else b
        yield text[a:b]
        if b == len(text):
            return
        back = text.find(" ", max(a + 1, b - OVERLAP), b)  # spaced-out words across the cut are seen again
        a = back if back > 0 else b


def words(text: str | None) -> set[str]:
    """The distinct words of a text as the kernel reads them."""
    out: set[str] = set()
    for piece in pieces(text):
        out.update(w.strip(EDGE) for w in piece.split())
        out.update(re.sub(r"\W+", "", m) for m in SPACED.findall(piece))
    return out


def codes(word: str) -> list[int]:
    """Letters as small numbers between two boundary marks; accents stay apart from plain letters."""
    if sum(c.isalpha() for c in word) < 2:
        return []
    word = word.translate(SIGNS)
    out = [0]
    for c in unicodedata.normalize("NFC", word):
        if "a" <= c <= "z":
            out.append(ord(c) - 96)
        elif c.isalpha():
            out.append(27 + ord(c) % 36)
    return [*out, 63] if len(out) > 1 else []


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) triples of the normalised kernel's explicit features."""
    coded = [codes(w) for w in vocabulary]
    lengths = np.array([len(c) for c in coded], np.int64)
    flat = np.array([x for c in coded for x in c], np.int64)
    owner = np.repeat(np.arange(len(coded)), lengths)
    rest = np.repeat(lengths, lengths) - (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    keys, weights = [], []
    for i, j in GAPS:
        at = np.flatnonzero(rest > j)
        keys.append((owner[at] * ALPHABET + flat[at]) * ALPHABET * ALPHABET + flat[at + i] * ALPHABET + flat[at + j])
        weights.append(np.full(len(at), DECAY ** (j - 2)))
    key = np.concatenate(keys)
    key, inverse = np.unique(key, return_inverse=True)
    weight = np.bincount(inverse, np.concatenate(weights), len(key)) if len(key) else np.empty(0)
    word, sub = key // ALPHABET**3, key % ALPHABET**3
    norm = np.sqrt(np.bincount(word, weight**2, len(coded)))
    return word, sub, weight / norm[word] if len(key) else weight


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Kernel matrix of two lists of words, by a table of the subsequences that the right one has."""
    w, s, v = features(left)
    rw, rs, rv = features(right)
    known, place = np.unique(rs, return_inverse=True)
    table = np.zeros((len(known), len(right)), np.float32)
    table[place, rw] = rv
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(known):
        return out
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    hit = known[at] == s
    w, at, v = w[hit], at[hit], v[hit].astype(np.float32)
    for a in range(0, len(w), STEP):  # triples lie by word
        part = w[a : a + STEP]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[first]] += np.add.reduceat(table[at[a : a + STEP]] * v[a : a + STEP, None], first)
    return out


def svm(x: np.ndarray, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, reg: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, a margin and a weight for each row, by Newton steps on the rows inside."""
    weight = weight / weight.sum()
    z = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    ridge = np.diag(np.append(np.full(x.shape[1], reg), reg * 1e-3))
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.maximum(0, margin - y * (z @ w)) ** 2 + w @ ridge @ w)

    now = loss(w)
    for _ in range(rounds):
        inside = y * (z @ w) < margin
        za, wa = z[inside], weight[inside]
        half = za * np.sqrt(wa)[:, None].astype(np.float32)
        step = np.linalg.solve((half.T @ half).astype(np.float64) + ridge, za.T @ (wa * y[inside] * margin[inside])) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w, last, now = w + size * step, now, loss(w + size * step)
        if last - now < 1e-7 * last:
            break
    return w[:-1], float(w[-1])


class Model:
    """One weight per subsequence, a bias, and the map from a document's worst words to a probability.

    ``longest`` is the largest number of distinct words that counts: what training has seen, so that a long clean text
    around an insult cannot outweigh it."""

    def __init__(self, table: np.ndarray, bias: float, scale: tuple[float, ...], longest: float = math.inf):
        self.table, self.bias, self.scale, self.longest = table, bias, scale, longest
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.table, self.bias, self.scale, self.longest

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, vocabulary: list[str]) -> np.ndarray:
        w, s, v = features(vocabulary)
        return np.bincount(w, self.table[s] * v, len(vocabulary)) + self.bias if len(vocabulary) else np.empty(0)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """(highest, second highest) word score of each text, and the logarithm of its number of distinct words."""
        bags = [words(t) for t in texts]
        new = list({w for bag in bags for w in bag if w not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list({w for bag in bags for w in bag})
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.cache.update(zip(part, self.word_scores(part).tolist()))
        out = np.full((len(texts), 3), LOWEST)
        for i, bag in enumerate(bags):
            top = sorted((self.cache[w] for w in bag), reverse=True)[:2] if bag else []
            out[i, : len(top)] = top
        out = np.clip(out, LOWEST, HIGHEST)
        out[:, 2] = [math.log1p(min(len(bag), self.longest)) for bag in bags]
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        if not self.scale:
            return np.zeros(len(texts))
        *slopes, shift = self.scale
        return 1 / (1 + np.exp(-np.clip(self.worst(texts) @ np.array(slopes) + shift, -50, 50)))


def _fresh(texts: list[str], seen: set[int]) -> tuple[list[str], Counter[str]]:
    """Documents that hold a sentence not in ``seen`` yet, and in how many of them each word of such sentences is.

    Copies and passages that many documents share count once, so their words do not look telling."""
    kept, counts = [], Counter()
    for text in texts:
        fresh = [s for s in SENTENCE.split(text) if s.strip() and hash(s) not in seen]
        seen.update(map(hash, fresh))
        bag = {w for s in fresh for w in words(s) if codes(w)}
        if bag:
            kept.append(text)
            counts.update(bag)
    return kept, counts


def variants(word: str) -> Iterator[str]:
    """The word with one more character at each inner place: a letter twice, or a foreign one."""
    for i in range(1, len(word)):
        yield word[:i] + word[i - 1] + word[i:]
        yield word[:i] + "x" + word[i:]


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, turns: int = 4) -> Model:
    """Train on the sentences of toxic and clean documents."""
    if not toxic or not clean:
        return Model(np.zeros(ALPHABET**3), 0.0, ())
    seen: set[int] = set()
    clean, good = _fresh(clean, seen)  # first, so a sentence of both kinds is clean
    toxic, bad = _fresh(toxic, seen)
    if not toxic or not clean:
        return Model(np.zeros(ALPHABET**3), 0.0, ())
    share = len(toxic) / (len(toxic) + len(clean))
    pure = {w for w, n in bad.items() if n / len(toxic) >= PURITY * (n / len(toxic) + good[w] / len(clean))}
    surprise = {w: (n - share * (n + good[w])) / math.sqrt(share * (1 - share) * (n + good[w])) for w, n in bad.items()}
    ranked = sorted(surprise, key=lambda w: (-surprise[w], w))
    first = [w for w in ranked if surprise[w] > SURPRISE and w in pure]
    if not first:
        return Model(np.zeros(ALPHABET**3), 0.0, ())
    common = sorted(good, key=lambda w: (-good[w], w))
    half = landmarks // 2
    close: list[tuple[float, str]] = []  # clean words most like the first witnesses
    for a in range(0, len(common), 10_000):
        part = common[a : a + 10_000]
        close += zip((-kernel(part, first[:half]).max(axis=1)).tolist(), part)
        close = sorted(close)[:NEGATIVES]
    near = [w for _, w in close]
    negatives = sorted({*common[:NEGATIVES], *near, *[w for w in ranked if good[w] and w not in pure][:NEGATIVES]})
    marks = sorted({*first[:half], *near[: landmarks - half - 32], *common[:32]})
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    xn = kernel(negatives, marks) @ root
    wn = np.sqrt(np.array([good[w] for w in negatives], float))
    bent = sorted({v for w in first[:half] for v in variants(w)} - set(good))
    xv = kernel(bent, marks) @ root
    unseen = sorted(w for w, n in bad.items() if not good[w] and n > 1 and w not in set(first))
    later: set[str] = set()
    model = Model(np.zeros(ALPHABET**3), 0.0, ())
    mw, ms, mv = features(marks)
    for _ in range(turns):
        chosen = [*first, *sorted(later)]
        xp = kernel(chosen, marks) @ root
        wp = np.sqrt(np.array([bad[w] for w in chosen], float))
        weight = np.concatenate((wp / wp.sum(), np.full(len(bent), BENT / max(1, len(bent))), wn / wn.sum()))
        margin = np.repeat([1.0, LATER, LATER, 1.0], [len(first), len(later), len(bent), len(negatives)])
        y = np.repeat([1.0, -1.0], [len(chosen) + len(bent), len(negatives)])
        coefficients, bias = svm(np.vstack((xp, xv, xn)), y, margin, weight, REG)
        model = Model(np.bincount(ms, mv * (root @ coefficients)[mw], ALPHABET**3), bias, ())
        # words that no clean document has and the SVM finds toxic are witnesses too, with less of a margin
        for a in range(0, len(unseen), 20_000):
            part = unseen[a : a + 20_000]
            later.update(w for w, f in zip(part, model.word_scores(part)) if f > SURE)
    x = np.vstack((model.worst(toxic), model.worst(clean)))
    y = np.concatenate((np.ones(len(toxic)), -np.ones(len(clean))))
    model.scale = _logistic(x, y)
    model.longest = float(np.quantile(np.expm1(x[:, 2]), LONGEST))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        grad = z.T @ (p - (y > 0)) / len(z) + 1e-4 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + 1e-4 * np.eye(len(w)), grad)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most ``max_toxic`` and ``max_clean`` labelled documents outside the held-out part.

    One text of each id comes to the driver (of several the smallest); a toxic one beyond ``MAX_CHARS`` does not, as a
    stretch of it need not hold what makes it toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(f"NOT {held_out('doc_id', MOD, REMAINDER)}")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = bounded_sample(known, "y", "doc_id", max(max_toxic, max_clean)).where(
        f"_rank <= IF(y = 1, {max_toxic}, {max_clean})").select("doc_id", "y")
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(F.broadcast(ids), "doc_id").selectExpr(
        "doc_id", "y", f"{excerpt('text', 'doc_id', MAX_CHARS)} AS t", f"LENGTH(text) > {MAX_CHARS} AS cut").where(
        "y = 0 OR NOT COALESCE(cut, FALSE)").groupBy("doc_id", "y").agg(F.min("t").alias("t")).collect()
    rows = sorted((r.doc_id, r.y, r.t or "") for r in rows)
    return fit([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0])


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                p = shared.value.probabilities(part["t"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(p), pa.array((p >= ACCEPT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                       F.expr(held_out(doc_id, MOD, REMAINDER)).alias("held_out"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they came; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield part.select(["row"]).filter(pa.array(shared.value.probabilities(part["t"].to_pylist()) < ACCEPT))

    row = "row struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema) + ">"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    return packed.mapInArrow(run, row).select("row.*")
