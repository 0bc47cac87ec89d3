"""The learned operators' results recomputed in plain Python: language, quality, toxicity."""

import math
import re

import numpy as np
import zstandard

from scoreplane.llm import langid, quality, toxicity
from scoreplane.llm.common import table


def compressed(model, lang, data):
    """Bytes of all chunks under the language's repeated dictionary, each chunk with a compressor of its own settings."""
    longest = max(len(v) for v in model.dictionaries.values())
    own = filled = model.dictionaries[lang]
    while len(filled) < longest:
        filled = own + b"\n" + filled if filled is not own else own + b"\n" + own
    filled = filled[-longest:]
    params = zstandard.ZstdCompressionParameters.from_level(
        langid.LEVEL, source_size=langid.CHUNK, dict_size=longest, write_content_size=False, write_checksum=False, write_dict_id=False)
    given = zstandard.ZstdCompressionDict(filled, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return sum(len(zstandard.ZstdCompressor(dict_data=given, compression_params=params).compress(data[a:a + langid.CHUNK]))
               for a in range(0, len(data), langid.CHUNK))


def test_language_by_plain_zstandard(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    model = langid.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    checked = 0
    for r in langid.predictions(docs, model).collect():
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(text) < 6000:
            data = text.lower().encode()
            sizes = {k: compressed(model, k, data) for k in model.langs}
            least = min(sizes.values())
            assert r.lang_pred == min(k for k in sizes if sizes[k] == least)
            parts = math.ceil(len(data) / langid.CHUNK)
            assert math.isclose(r.score, 1 / sum(2 ** -min(60, (n - least) / parts) for n in sizes.values()), rel_tol=1e-9)
            checked += 1
    assert checked > 50


def test_languages_share_a_bounded_sample(make, monkeypatch):
    monkeypatch.setattr(langid, "ALL_EXCERPTS", 12)
    rows = [(100 * n + i, f"words of {lang} number{i}", lang) for n, lang in enumerate(("aa", "bb", "cc")) for i in range(60)]
    model = langid.train(make(rows))
    assert model.langs == ["aa", "bb", "cc"]
    assert [v.count(b"words") for _, v in sorted(model.dictionaries.items())] == [4, 4, 4]
    monkeypatch.setattr(langid, "ALL_EXCERPTS", 1)
    assert [v.count(b"words") for v in langid.train(make(rows)).dictionaries.values()] == [1, 1, 1]


def probability(net, text):
    """The network's answer by loops over chunks, places and bytes."""
    data = (text or "").encode()
    step, last = quality.CHUNK - quality.OVERLAP, quality.WIDTH - 1
    pooled, a = [], 0
    while True:
        part = data[a:a + quality.CHUNK + last].ljust(quality.CHUNK + last, b"\0")
        best = [max(v) for v in zip(*(sum(net.filters[j][part[i + j]] for j in range(quality.WIDTH)) for i in range(quality.CHUNK)))]
        pooled.append([math.tanh(b + c) for b, c in zip(best, net.bias)])
        a += step
        if a + quality.OVERLAP >= len(data):
            break
    z = [sum(c) / len(c) for c in zip(*pooled)] + [max(c) for c in zip(*pooled)]
    return 1 / (1 + math.exp(-(sum(x * float(w) for x, w in zip(z, net.out)) + float(net.shift[0]))))


def test_quality_by_loops_over_bytes(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    net = quality.train(docs, table(spark, sf_small, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = [r for r in quality.scores(docs, net).collect() if len(texts[r.doc_id] or "") < 2500]
    assert len(got) > 20
    for r in got[:60]:
        assert abs(r.score - probability(net, texts[r.doc_id])) < 1e-4, r
        assert r.predicted == (r.score >= 0.5)


def test_a_repeated_training_id_counts_once(spark, make):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    rows = [(i, ("good words of sense " if i % 2 else "zq#xx jj%%vv ") * 5 + str(i)) for i in range(60)]
    one, two = (quality.train(make(r), labels) for r in (rows, rows + [rows[3]] * 40 + [(3, "zz later text")]))
    assert np.array_equal(one.filters, two.filters) and np.array_equal(one.out, two.out)


def word_score(model, word):
    """A word's score by its subsequences of three characters, one by one."""
    c, v = toxicity.codes(word), {}
    for i in range(len(c)):
        for j in range(i + 1, min(len(c), i + toxicity.SPAN)):
            for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                key = (c[i] * toxicity.ALPHABET + c[j]) * toxicity.ALPHABET + c[k]
                v[key] = v.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    norm = math.sqrt(sum(x * x for x in v.values()))
    return sum(model.table[u] * x / norm for u, x in v.items()) + model.bias


def test_toxicity_by_explicit_sums(spark, sf_mid):
    docs = table(spark, sf_mid, "documents")
    model = toxicity.train(docs, table(spark, sf_mid, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = [r for r in toxicity.scores(docs, model).collect() if len(texts[r.doc_id] or "") < 4000]
    low, high = toxicity.LOWEST, toxicity.HIGHEST
    for r in got[:200]:
        text = (texts[r.doc_id] or "").lower()
        bag = {w.strip(toxicity.EDGE) for w in text.split()} | {re.sub(r"\W+", "", m) for m in toxicity.SPACED.findall(text)}
        top = sorted((word_score(model, w) for w in bag), reverse=True)[:2]
        x = [min(high, max(low, s)) for s in (top + [low, low])[:2]] + [math.log1p(min(len(bag), model.longest))]
        z = sum(a * b for a, b in zip(x, model.scale)) + model.scale[-1]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.3)
    assert len(got) > 100 and any(r.predicted for r in got)
