import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scoreplane.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                        * ((1000000000 * b[w]) // (1000 * b[w] + 12 * (75 + 25 * b.total() * n // total)))
                        for w in terms(text) if w in b)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Émile", "ÉMILE", "It's", "漢字", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # many ties
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 40])))) for i in range(30)]
    return docs, [*items, (98, "w1 w1 w1 W1"), (99, "nowhere"), (100, docs[7][1])]


def with_items(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, term int, shard string")


@pytest.mark.parametrize("docs_a_shard,together,chars", [(16384, 64, 4_000_000), (7, 1, 50), (50, 3, 1000)])
def test_brute_force_over_shards_blocks_and_ties(spark, make, corpus, monkeypatch, docs_a_shard, together, chars):
    docs, items = corpus
    monkeypatch.setattr(ranked, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(ranked, "TOGETHER", together)
    if docs_a_shard == 7:
        items = items[-8:]
    assert got(ranked.search(make(docs), with_items(spark, items), block_chars=chars)) == brute(docs, items)


def test_edge_rows_and_clashing_columns(spark, make, odd):
    items = [(1, "a B c"), (1, "é"), (None, "w1 w7919 tail"), (3, None), (4, ""), (5, "x" * 50000)]
    assert got(ranked.search(make(odd), with_items(spark, items))) == brute([r[:2] for r in odd], items)
    assert got(ranked.search(make([]), with_items(spark, items))) == []
    assert got(ranked.search(make(odd), with_items(spark, []))) == []
    assert got(ranked.search(make([(1, None), (2, "?!")]), with_items(spark, items))) == []


def test_large_ids_keep_every_digit(spark, make):
    docs = [(2**62 + 1, "only one"), (None, "only one"), (-5, "only two")]
    assert got(ranked.search(make(docs), with_items(spark, [(1, "only one")]))) == brute(docs, [(1, "only one")])


def test_long_texts_in_pieces(monkeypatch):
    text = "Ab, cd ÉF--gh " * 50 + "z" * 100 + " end"
    whole = Counter(terms(text))
    monkeypatch.setattr(ranked, "LONG_TEXT", 10)
    for piece in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(ranked, "PIECE", piece)
        assert ranked.term_counts(text) == whole


def test_sparse_tables_give_the_largest_impact_of_any_stretch():
    rng = np.random.default_rng(1)
    docs = [np.sort(rng.choice(500, n, replace=False)) for n in (1, 2, 17, 300)]
    impacts = [rng.integers(0, 50, len(d)) for d in docs]
    lists = ranked.Lists(docs, impacts, 500)
    for k, values in enumerate(impacts):
        for _ in range(200):
            a, b = sorted(rng.integers(0, len(values) + 1, 2))
            best, place = lists.largest(lists.starts[k] + np.array([[a]]), lists.starts[k] + np.array([[b]]))
            assert best[0, 0] == (values[a:b].max() if b > a else 0)
            assert b == a or lists.impacts[place[0, 0]] == best[0, 0]
