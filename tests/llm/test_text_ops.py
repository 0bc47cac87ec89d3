"""Language, chat formatting, quality, toxicity, decontamination and URL filters."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import brute
from scoreplane.llm import chat, decontaminate, langid, quality, queries, toxicity, urls
from scoreplane.llm.common import table


def out(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


# language

def test_language_held_out(spark, sf_mid):
    got = queries.op4_language(spark, sf_mid).collect()
    lang = {r.doc_id: r.lang for r in table(spark, sf_mid, "documents").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == out(r.doc_id, 4, 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.8 * len(held) and sum(r.lang_pred == lang[r.doc_id] for r in sure) / len(sure) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(make, odd, sf_mid, spark):
    model = langid.train(table(spark, sf_mid, "documents"))
    got = langid.predictions(make(odd), model).collect()
    assert len(got) == len(odd)
    assert [r.lang_pred for r in got if r.doc_id in (3, 4, -3)] == ["und"] * 3
    assert langid.predictions(make([(1, "12 + 34 = 46 !")]), model).first().lang_pred == "und"
    assert langid.predictions(make([]), model).count() == 0
    empty = langid.train(make([(1, None), (2, "")]))
    assert langid.predictions(make([(1, "some text")]), empty).first().lang_pred == "und"
    assert langid.train(make([])).langs == []


def test_narrow_margins_are_rejected():
    model = langid.Model({"a": b"the same words here " * 30, "b": b"the same words here " * 30})
    assert model.predict("the same words here") == ("a", 0.5, False)


def test_tiny_language_beside_large_ones(spark, make, sf_mid):
    docs = table(spark, sf_mid, "documents").select("doc_id", "text", "lang")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    tiny = next(i for i in range(10 ** 9, 10 ** 9 + 99) if not out(i, 4, 2))
    model = langid.train(docs.unionByName(make([(tiny, "xyzzy p", "zz")], extra=False).select("doc_id", "text", "lang")))
    assert model.langs == ["de", "en", "es", "fr", "zz"] and len(model.dictionaries["en"]) > 100_000
    assert len({len(model.filled(k)) for k in model.langs}) == 1
    held = langid.predictions(docs, model).where("held_out").collect()
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    assert right > 0.95, right
    assert model.predict("xyzzy p and xyzzy p and more xyzzy p")[0] == "zz"


# chat

def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["\\", "#", "###", "### Assistant: ", "</turn>", " </turn>\n", "a", "é漢𝒳", "\n", ": ", "\\###", "\\</turn>"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c if c else None, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "system", "a: b", None, ""]),
                         rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 7)))])))
    got = {r.conv_id: r for r in chat.read_back(chat.segments(turns_of(spark, rows))).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        said = [(r, x) for _, _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), brute.turns_digest(said))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_machine(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "u"), ("assistant", "a")]
    cases = {1: good, 2: good[1:], 3: good[:2], 4: [good[2]], 5: [good[1], good[1], good[2]], 6: [("user", "u"), ("tool", "x")],
             7: [good[1], good[2], good[0]]}
    rows = [(c, n, r, t) for c, turns in cases.items() for n, (r, t) in enumerate(turns)]
    got = {r.conv_id: r.valid for r in chat.read_back(chat.segments(turns_of(spark, rows))).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert chat.read_back(chat.segments(turns_of(spark, []))).count() == 0


def test_chat_segments_and_hostile_texts(spark, sf_small):
    rows = chat.segments(turns_of(spark, [(1, 0, "user", queries.HOSTILE), (1, 1, "assistant", queries.HOSTILE)])).collect()
    assert [r.part for r in rows] == ["open", "text", "close"] * 2 and [r.loss for r in rows] == [False] * 4 + [True, False]
    assert rows[0].text == "### user: " and all("\\### Assistant: \\</turn> ok" in r.text for r in (rows[1], rows[4]))
    got = {r.conv_id: r for r in queries.op6_chat(spark, sf_small).collect()}
    by = {}
    for r in table(spark, sf_small, "conversations").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    by[-7] = [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]
    assert {c: (len(t), brute.turns_digest(t)) for c, t in by.items()} == {
        c: (r.n_turns, r.turns_sha256) for c, r in got.items()}


# quality and toxicity

def held(spark, sf, df, label):
    told = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    rows = [(r.predicted, told[r.doc_id]) for r in df.collect() if r.held_out and r.doc_id in told]
    return [sum(r == pair for r in rows) for pair in ((1, 1), (1, 0), (0, 1), (0, 0))]


def test_quality_held_out(spark, sf_mid):
    tp, fp, fn, tn = held(spark, sf_mid, queries.op8_quality(spark, sf_mid), "quality")
    assert tp / (tp + fn) > 0.95 and tn / (tn + fp) > 0.7


def test_quality_odd_rows(spark, make, odd, sf_mid):
    net = quality.train(table(spark, sf_mid, "documents"), table(spark, sf_mid, "labels"))
    got = quality.scores(make(odd), net).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.scores(make([]), net).count() == 0
    same = quality.train(make([(1, "a")]), spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert quality.scores(make([(1, "a")]), same).first().score == 0.5


def test_chunks_cover_every_window():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 31, 32, 33, 511, 512, 513, 992, 5000):
        data = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        chunks = quality.chunked(data.decode())
        seen = {bytes(c[i:i + quality.WIDTH]) for c in chunks for i in range(quality.CHUNK)}
        assert {data[i:i + quality.WIDTH] for i in range(max(0, n - quality.WIDTH + 1))} <= seen


def test_convolution_by_hand():
    net = quality.Network(3)
    net.out += 1
    data = np.frombuffer(b"hello world", np.uint8)
    chunk = quality.chunked("hello world")[0]
    best = [max(sum(net.filters[j][chunk[i + j]][f] for j in range(quality.WIDTH)) for i in range(quality.CHUNK))
            for f in range(quality.FILTERS)]
    assert np.allclose(net.pooled(quality.chunked("hello world"))[0], np.tanh(best), atol=1e-5) and len(data) == 11


def test_toxicity_held_out(spark, sf_mid):
    tp, fp, fn, tn = held(spark, sf_mid, queries.op9_toxicity(spark, sf_mid), "toxic")
    assert tp / (tp + fn) > 0.6 and tn / (tn + fp) > 0.9


@pytest.fixture(scope="module")
def large_model(spark):
    sf = "/root/testdata/sf0.1"
    return toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))


def test_toxicity_held_out_by_language(spark, large_model):
    sf = "/root/testdata/sf0.1"
    told = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = [r for r in toxicity.scores(table(spark, sf, "documents"), large_model).collect() if r.held_out and r.doc_id in told]
    toxic = [r for r in got if told[r.doc_id] == 1]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    for name in {lang[r.doc_id] for r in toxic}:
        own = [r.predicted for r in toxic if lang[r.doc_id] == name]
        assert len(own) < 10 or sum(own) > 0.5 * len(own), (name, sum(own), len(own))
    clean = [r.predicted for r in got if told[r.doc_id] == 0]
    assert sum(clean) <= 0.02 * len(clean)


def test_an_insult_in_a_very_long_text_is_found(spark, make, large_model):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 0"), "doc_id").where(
        "lang = 'en'").orderBy("doc_id").select("text").collect()
    text = " ".join(r.text or "" for r in rows)
    text = (text * (1 + 1_000_000 // len(text)))[:1_000_000]
    half = len(text) // 2
    insult = text[:half] + " . You are a stupid worthless idiot . " + text[half:]
    got = {r.doc_id: r for r in toxicity.scores(make([(1, text), (2, insult)]), large_model).collect()}
    assert got[1].predicted == 0 and got[2].predicted == 1 and got[2].score > 0.8


def test_toxicity_learns_from_one_row_of_an_id(spark, make):
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    once = [(i, f"word{i} some talk and " + ("vile brute" if i < 20 else "fine friend") + f" of day{i}") for i in range(60)]
    a, b = (toxicity.train(make(rows), labels) for rows in (once, once + [once[3]] * 50 + [once[40]] * 50))
    assert np.array_equal(a.table, b.table) and a.scale == b.scale
    long_toxic = [(i, t + " x" * 30_000 if i < 20 else t) for i, t in once]
    assert toxicity.scores(make(once), toxicity.train(make(long_toxic), labels)).where("score > 0").count() == 0


def kernel_by_hand(a, b):
    def phi(w):
        c, v = toxicity.codes(w), {}
        for i in range(len(c)):
            for j in range(i + 1, min(len(c), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    v[c[i], c[j], c[k]] = v.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i - 2)
        n = sum(x * x for x in v.values()) ** 0.5
        return {u: x / n for u, x in v.items()}

    x, y = phi(a), phi(b)
    return sum(v * y.get(u, 0) for u, v in x.items())


def test_kernel_by_hand_and_folded_weights():
    words = ["idiot", "idixot", "i.d.i.o.t", "the", "tontothe", "réeux", "of"]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, [[kernel_by_hand(a, b) for b in words] for a in words], atol=1e-5)
    assert k[0, 1] > 0.5 > k[0, 4]


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(8)
    clean = [" ".join(rng.choice("the of and to is it on an thing other mention green".split()) for _ in range(30)) for _ in range(300)]
    bad = ["idiot", "moron", "stupid", "scum"]
    toxic = []
    for t in clean[:150]:
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        toxic.append(" ".join(w))
    return toxicity.fit(toxic, clean)


def test_toxicity_tolerates_inserted_characters(insults):
    base = "the of and to is it on an thing other"
    p = insults.probabilities([base, base + " idiot moron", base + " id.iot mo-ron", base + " idixot morzon", base + " i d i o t and m o r o n",
                               base + " 1d10t", None, ""])
    assert p[0] < 0.3 and (p[1:5] >= 0.3).all() and p[6] < 0.3 and p[7] < 0.3


def test_toxicity_odd_rows(spark, make, odd, insults):
    got = toxicity.scores(make(odd), insults).collect()
    assert len(got) == len(odd) and all(r.predicted == 0 for r in got)
    kept = toxicity.accepted(make([*odd, (99, "you idiot stupid moron")]), insults)
    assert kept.count() == len(odd) and kept.columns == make(odd).columns
    assert toxicity.scores(make([]), insults).count() == 0
    none = toxicity.train(make(odd), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.scores(make([(1, "idiot")]), none).first().score == 0.0


# decontamination

def test_myers_against_full_table():
    rng = random.Random(6)
    for _ in range(400):
        p = "".join(rng.choices("ab c", k=rng.randint(1, 20)))
        t = "".join(rng.choices("ab c", k=rng.randint(0, 60)))
        best = brute.best_match(p, t)
        hit = decontaminate.myers(p, t, 5)
        assert (hit[0] if hit else 6) == min(best, 6)


def norm(t):
    import regex
    return regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).strip()


def test_matches_are_all_within_budget(spark, make):
    rng = random.Random(7)
    words = [f"w{'abcdefgh'[i % 8]}{i}" for i in range(40)]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for n in range(15)] + [(50, "the"), (51, None), (52, " ! ")]
    docs = []
    for n in range(150):
        w = rng.choices(words, k=rng.randint(5, 60))
        if n % 2:
            x = list(rng.choice(items[:15])[1])
            for _ in range(rng.randint(0, 8)):
                x[rng.randrange(len(x))] = rng.choice("xyz!")
            w.insert(rng.randrange(len(w)), "".join(x).upper())
        docs.append((n, " ".join(w)))
    docs += [(200, "other"), (201, "the"), (202, "bathe the. end"), (203, None), (204, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, t in docs:
        for n, x in items:
            p, d = norm(x), norm(t)
            e = int(decontaminate.RATE * len(p))
            if p and (f" {p} " in f" {d} " if not e else brute.best_match(p, d) <= e):
                want.add((i, n, brute.best_match(p, d)))
    for block in (decontaminate.BLOCK_CHARS, 300):
        got = decontaminate.matches(make(docs), bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    clean = decontaminate.clean(make(docs), bench, block_chars=300)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in docs} - {i for i, *_ in want})


def test_decontamination_odd_rows(spark, make, odd):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "é ü 漢字 x"), (2, None)], "item_id bigint, text string")
    got = decontaminate.matches(make(odd), bench).collect()
    assert len(got) == 3 * 2 + 2
    kept = decontaminate.clean(make(odd), bench)
    assert kept.columns == make(odd).columns and kept.count() == len(odd) - 5
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(make(odd), none).count() == 0 and decontaminate.clean(make(odd), none).count() == len(odd)
    assert decontaminate.matches(make([]), bench).count() == 0


# URL filters

def by_hand(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    m = min([rest.find(c, n) for c in "?#" if rest.find(c, n) >= 0] + [len(rest)])
    return host, rest[n:m]


def rule_by_hand(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_parts_and_fixed_rules(spark):
    cases = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "https://www.example.com/EN/", "http://x.net/es/1", "http://net/es/",
             "http://xnet/es/", "ftp://É.Net/fr/é", "a://b://c/d", "://", "://?x", "http://h#f/p", "http://h?a/b", None, "", "no url", "x://com",
             "http://com/", "http://user@Host.com:80/en/", "http://a\nb.com/\n/x"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").selectExpr("*", "1 AS key", "2 AS tokens", "3 AS u")
    labels = spark.createDataFrame([], "key bigint, blocked boolean")
    got = {r.key: r for r in urls.verdicts(pages, labels, queries.URL_RULES).collect()}
    for n, u in enumerate(cases):
        host, path = by_hand(u)
        rule, verdict = rule_by_hand(host, path)
        assert (got[n].host, got[n].path, got[n].rule, got[n].verdict) == (host, path, rule, verdict or "allow"), u


def rules_by_hand(rows, min_confidence, least):
    from itertools import combinations
    count, bad = {}, {}
    for tokens, blocked in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                count[c] = count.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + blocked
    return {c: bad[c] / n for c, n in count.items() if bad[c] >= least and bad[c] / n >= min_confidence}


def test_mined_verdicts_match_all_combinations(spark, monkeypatch):
    monkeypatch.setattr(urls, "MIN_ROWS", 5)
    rng = random.Random(3)
    rows, told = [], []
    for n in range(400):
        host = rng.choice(["a.org", "b.org", "m.a.org", "c.com"])
        seg = rng.choice(["win", "news", "bet", "x1"])
        url = f"http://{host}/{seg}/{rng.randrange(9)}" + rng.choice(["", "?ref=1", "?ad=2&ref=3", ".html"])
        rows.append((n, url))
        told.append((n, rng.random() < (0.97 if seg == "bet" and "a.org" in host else 0.1)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame(told[:300], "key bigint, blocked boolean")
    got = {r.key: r for r in urls.verdicts(pages, labels, (), min_support=0.001).collect()}
    tokens = {r.key: set(r.tokens) for r in urls.parsed(pages).selectExpr("key", f"{urls.TOKENS} AS tokens").collect()}
    rules = rules_by_hand([(tokens[n], b) for n, b in told[:300]], urls.MIN_CONFIDENCE, 5)
    assert rules
    for n, _ in rows:
        fired = [c for s, c in rules.items() if set(s) <= tokens[n]]
        assert got[n].verdict == ("block" if fired else "allow")
        assert not fired or abs(got[n].confidence - max(fired)) < 1e-9


def test_rules_fire_on_every_token_of_a_class(spark):
    rows = [(n, f"http://blog.spam.org/offer/win/{n}") for n in range(30)] + [(100 + n, f"http://a.org/page/{n}") for n in range(30)]
    unseen = {200: ("http://m.spam.org/x", "block", "h:spam.org"), 201: ("http://spam.org/", "block", "h:spam.org"),
              202: ("http://b.net/win", "block", "p:win"), 203: ("http://b.net/x", "allow", None),
              204: ("http://blog.spam.org/offer", "block", "h:blog.spam.org")}
    pages = spark.createDataFrame(rows + [(k, v[0]) for k, v in unseen.items()], "page_id bigint, url string")
    labels = spark.createDataFrame([(k, k < 100) for k, _ in rows], "key bigint, blocked boolean")
    got = {r.key: r for r in urls.verdicts(pages, labels, ()).collect()}
    assert {k: (got[k].verdict, got[k].mined) for k in unseen} == {k: v[1:] for k, v in unseen.items()}
    assert all(got[k].verdict == ("block" if k < 100 else "allow") for k, _ in rows)


def test_url_labels_null_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, True), (1, None), (None, True)], "key bigint, blocked boolean")
    got = urls.verdicts(pages, labels, queries.URL_RULES).collect()
    assert len(got) == 3 and all(r.verdict == "allow" for r in got)
    assert urls.verdicts(pages.where("FALSE"), labels, queries.URL_RULES).count() == 0
