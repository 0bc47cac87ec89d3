import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scoreplane.llm import spelling


def edited(a, b):
    """Whether b comes from a by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if edited(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéÈñß×") for _ in range(rng.choice([4, 5, 6, 9]))) for _ in range(25)]
    words = list(stems)
    for w in stems * 6:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abxÿ") + w[i:], w[:i] + "z" + w[i + 1:]]))
    chain = (999, "chaina " * 40 + "chainab " * 15 + "chainabb " * 5)
    return [chain] + [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 3, 200])))
             .replace("a", rng.choice("aA"))) for i in range(120)]


def test_brute_force(make, corpus):
    want = brute(corpus)
    assert any(r[1] for r in want) and any(r[2] != r[0] and r[2] != r[1] for r in want)
    assert got(spelling.groups(make(corpus))) == want


def test_small_tables_and_full_bitmap(make, corpus, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    monkeypatch.setattr(spelling, "MAX_BITS", 64)
    monkeypatch.setattr(spelling, "LONG_WORD", 5)
    monkeypatch.setattr(spelling, "CELLS", 40)
    assert got(spelling.groups(make(corpus[:60]))) == brute(corpus[:60])


def test_edge_rows_and_clashing_columns(make, odd):
    assert got(spelling.groups(make(odd))) == brute([r[:2] for r in odd])
    assert got(spelling.groups(make([]))) == []
    assert got(spelling.groups(make([(1, None), (2, "")]))) == []


def test_very_long_words(make):
    word = "".join(chr(97 + i * i % 26) for i in range(30000))
    docs = [(i, w) for i, w in enumerate([word] * 8 + [word[:500] + word[501:]] * 3 + [word + "q"] * 4 + ["x" * 20000] * 3
                                         + ["x" * 20001] * 6)]
    want = brute(docs)
    assert any(r[4] >= 2 for r in want)
    assert got(spelling.groups(make(docs))) == want


def test_neighbourhoods_name_every_reduced_edit():
    rng = random.Random(2)
    for _ in range(50):
        w = "".join(rng.choice("abcdefghij") for _ in range(rng.choice([5, 6, 12])))
        made = set(np.concatenate([h.ravel() for h in spelling.neighbours([w])]).tolist())
        edits = [w] + [w[:i] + w[i + 1:] for i in range(len(w))] + [
            w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in "abcdefghijkéz" for k in (0, 1)]
        assert {int(spelling.names([e])[0]) for e in edits} <= made


def test_long_texts_in_pieces(monkeypatch):
    text = "Abcde fghIJ--klm é" * 30 + "z" * 100 + " end"
    whole = Counter(spelling.runs(text))
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    for piece in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(spelling, "PIECE", piece)
        assert spelling.run_counts(text) == whole
