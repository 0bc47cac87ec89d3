import math

import duckdb
import pytest

from scoreplane.llm import mixing, oracle


def targets(sizes, weights=(5, 2, 1)):
    """By repeated resharing, as told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {**out, **{s: level * w[s] for s in free}}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 500, "c": 3, "d": 900, None: 40}, {"a": 1, "b": 1, "c": 10000}, {"x": 7}, {"a": 0, "b": 5, "c": 100},
    {"Z": 400, "a": 2, "é": 50, "漢": 30, "": 4}])
def test_targets_and_totals(make, sizes):
    rows, n = [], 0
    for s, total in sizes.items():
        while total > 0:
            k = min(total, 1 + n * 7 % 90)
            rows.append((n, " ".join(["w"] * k), "en", s))
            total -= k
            n += 1
        if not sizes[s]:
            rows.append((n, " ", "en", s))
            n += 1
    got = mixing.mix_totals(make(rows), block_words=16, chunk=8).collect()
    want = targets(sizes)
    of = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_schedule_is_even_and_blocks_are_equal(make):
    rows = [(n, " ".join(["w"] * (5 + n % 40)), "en", f"s{n % 3}") for n in range(600)]
    _, t, mix = mixing.mixed(make(rows), block_words=16, chunk=64)
    slots = mixing.schedule(t, 16, 64).orderBy("slot").collect()
    share, seen = {}, {}
    for r in slots:
        share[r.sid] = share.get(r.sid, 0) + 1 / len(slots)
    for n, r in enumerate(slots, 1):
        seen[r.sid] = seen.get(r.sid, 0) + 1
        assert r.rank == seen[r.sid] - 1
        assert all(abs(seen.get(s, 0) - share[s] * n) < 10 for s in share)
    assert sum(r.words == 16 for r in slots) > len(slots) - 12
    served = {r.slot: r.n for r in mix.groupBy("slot").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert set(served) == {r.slot for r in slots}


def test_odd_rows_and_reruns(make, odd):
    docs = make(odd)
    a, b = ([tuple(r) for r in mixing.mix_totals(docs).collect()] for _ in range(2))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == len(odd)
    assert all(r[4] == 0 for r in a if r[1] == 0) and all(r[4] <= 3 * r[1] for r in a)
    assert mixing.mix_totals(make([])).count() == 0
    assert [tuple(r) for r in mixing.mix_totals(make([(1, None), (2, "")])).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_oracle_on_null_and_odd_sources(make):
    rows = [(n, " ".join(["w"] * (n * 13 % 70)), "en", [None, "b", "a", "ä"][n % 4]) for n in range(90)]
    got = sorted(tuple(round(x, 6) for x in r) for r in mixing.mix_totals(make(rows)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(tuple(round(x, 6) for x in r) for r in con.execute(oracle.MIXING).fetchall()) == got


def test_rows_without_or_of_one_id_spread_over_the_chunks(spark, make):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} of the many", "en", "s") for i in range(6000)]
    sized = mixing.sized(make(rows), "doc_id", "text", "source")
    assert sized.select("ord").distinct().count() == 6000
    got = mixing.mix_totals(make(rows), chunk=100).collect()
    assert len(got) == 6000 and sum(r.taken for r in got) == round(got[0].target)
