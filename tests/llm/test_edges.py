"""Very long texts, empty tables, repeated rows and clashing names, for operators whose own tests leave them out."""

import hashlib

import pytest

import brute
from scoreplane.llm import chat, decontaminate, langid, mixing, pii, quality, queries, urls

FILLER = "calm words about rivers and hills "


def test_long_turn_and_clashing_columns(spark):
    long = "### Assistant: \\ </turn> x " * 40000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS part", "2 AS loss", "3 AS valid", "4 AS n_turns", "5 AS k", "6 AS t")
    got = chat.read_back(chat.segments(turns)).collect()
    assert len(got) == 1 and got[0].n_turns == 3 and got[0].loss_chars == 2 * len(long)
    assert got[0].turns_sha256 == brute.turns_digest([(r, t) for _, _, r, t in rows])


def test_long_and_repeated_urls(spark):
    url = "http://a.b.example.com/en/" + "x/" * 20000 + "?" + "k=v&" * 5000
    pages = spark.createDataFrame([(1, url), (1, url), (2, "http://" + "s." * 5000 + "net/es/")], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, True)], "key bigint, blocked boolean")
    got = urls.verdicts(pages.selectExpr("*", "1 AS verdict", "2 AS rule", "3 AS rule_id"), labels, queries.URL_RULES).collect()
    assert sorted((r.key, r.rule, r.verdict) for r in got) == [(1, "example.com/en/", "block")] * 2 + [(2, "net/es/", "block")]
    assert max(len(r.path) for r in got) == 40004


def test_personal_data_behind_a_million_characters(make):
    text = FILLER * 30000 + "mail a.b@c.de"
    got = {r.doc_id: r for r in pii.find(make([(1, text), (2, text), (2, text), (3, "")])).collect()}
    place = f"email:{len(text) - 8}:{len(text)}"
    assert got[1].spans == got[2].spans == place and got[3].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(place.encode()).hexdigest()


def test_item_behind_a_million_characters(spark, make):
    item = "which of the seven bridges was closed by the mayor in the year of the great flood"
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    docs = make([(1, FILLER * 30000 + item.replace("seven", "sevem")), (2, FILLER * 30000)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == {(1, 7)}


def test_long_text_takes_part_in_the_mix(make):
    docs = make([(1, "w " * 400000, "en", "a"), (2, "w " * 10, "en", "b"), (2, "w " * 10, "en", "b")])
    got = sorted((r.doc_id, r.size, r.taken, r.target) for r in mixing.mix_totals(docs).collect())
    assert [r[1] for r in got] == [400000, 10, 10]
    assert abs(got[0][2] - got[0][3]) <= 1 and abs(got[1][2] + got[2][2] - got[1][3]) <= 1


@pytest.mark.parametrize("where", ["front", "end"])
def test_the_whole_text_is_scored_for_quality(spark, make, where):
    net = quality.Network(3)
    net.out = net.out + 0.01  # far from the flat ends of the logistic
    odd = "\x01\x02\x03" * 40
    texts = [FILLER * 30000, odd + FILLER * 30000 if where == "front" else FILLER * 30000 + odd]
    got = {r.doc_id: r.score for r in quality.scores(make([(1, texts[0]), (2, texts[1]), (2, texts[1])]), net).collect()}
    assert abs(got[1] - got[2]) > 1e-6


def test_the_whole_text_counts_for_its_language(make):
    model = langid.Model({"a": b"the same words here again " * 30, "b": "andere Wörter stehen dort ".encode() * 30})
    text = "the same words " * 2000 + "andere Wörter stehen " * 20000
    got = langid.predictions(make([(1, text), (1, text), (2, "the same words " * 20000)]), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "b"), (1, "b"), (2, "a")]
