import hashlib
import pickle
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scoreplane.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(codec, library):
    rng = random.Random(3)
    signs = "aaaaeeinst  \n\t'sré漢字ñ😀́١½.,!x0 7ხ\U00010ee7 'll"
    for n in [0, 1, 2, 17, 100, 1000] * 60:
        t = "".join(rng.choice(signs) for _ in range(n))
        assert codec.encode(t).tolist() == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t).tolist()) == t.encode()


@pytest.mark.parametrize("text", ["x" * 50000, "ab" * 9999, "abc" * 7001, " " * 4097, "=" * 1023 + "-" * 33, "é" * 3000,
                                  "".join(chr(97 + i * i % 26) for i in range(20001)), "\n" * 300 + "a"])
def test_long_matches_by_the_tree(codec, library, text):
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_joins_at_every_edge_and_small_runs(codec, library, monkeypatch):
    word = "internationalisationsüberprüfung" * 3
    data = word.encode()
    whole = codec.merged(data)
    for k in range(len(data) + 1):
        assert codec.joined(codec.merged(data[:k]), codec.merged(data[k:])) == whole
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "RUN", 3)
    monkeypatch.setattr(bpe, "KNOWN_MATCHES", 2)
    monkeypatch.setattr(bpe, "KNOWN_EDGES", 2)
    text = "one two, three  four\n\nfive's 123 \U00010ee7ab " * 9
    assert codec.encode(text).tolist() == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text).tolist()) == text.encode()


def test_newer_letters_split_as_in_the_library(codec, library):
    text = " ".join(f"a{chr(c)}a{chr(c)}1" for low, high in bpe.NEWER for c in {low, high, low - 1, high + 1})
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, public_tokenizers.PATTERN)


def test_edge_rows_and_clashing_columns(make, odd, codec, library):
    rows = bpe.round_trips(make(odd), pickle.loads(pickle.dumps(codec))).collect()

    def want(t):
        ids = library.encode_ordinary(t or "")
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest())

    key = str
    assert sorted(map(tuple, rows), key=key) == sorted(((r[0], *want(r[1])) for r in odd), key=key)
    assert bpe.round_trips(make([]), codec).collect() == []


def test_encoded_then_decoded(make, codec, library):
    docs = make([(1, "the end of the world"), (2, None), (None, "é")])
    ids = bpe.encoded(docs, codec)
    assert {r.doc_id: r.ids for r in ids.collect()} == {
        1: library.encode_ordinary("the end of the world"), 2: [], None: library.encode_ordinary("é")}
    assert {r.doc_id: bytes(r.data) for r in bpe.decoded(ids, codec).collect()} == {
        1: b"the end of the world", 2: b"", None: "é".encode()}


def test_query_on_whole_table(spark, sf_small, library):
    from scoreplane.llm.queries import op13_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, sf_small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
