import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest

import brute
from scoreplane.llm import components, exact_dedup, near_dup, shingles


def expected(rows):
    groups = {}
    for n, (i, t, *_) in enumerate(rows):
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 7, 16384])
def test_exact_groups_odd_rows(make, odd, block):
    if block < 100:
        rows = [r for r in odd if len(r[1] or "") < 1000]
    else:
        rows = odd
    got = exact_dedup.exact_groups(make(rows), block_chars=block).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r[1] or "" for r in rows})  # one row of each text, also where rows repeat
    assert all(r.id == r.keep_id for r in kept)


def test_exact_groups_random_block_trees(make):
    rng = random.Random(4)
    base = ["".join(rng.choices("ab", k=rng.randint(0, 14))) for _ in range(60)]
    rows = [(n, rng.choice(base)) for n in range(200)]
    got = exact_dedup.exact_groups(make(rows), block_chars=2).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)


def test_exact_groups_digest_collisions(make):
    rows = [(n, t) for n, t in enumerate(["aa", "ab", "aa", "abab", "aaab", "abaa", "abab", "", "b"])]
    got = exact_dedup.exact_groups(make(rows), block_chars=2, digest="CRC32(b) % 2").collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)


def test_exact_empty_and_keep_one(make, odd):
    assert exact_dedup.exact_groups(make([])).count() == 0
    docs = make(odd)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in odd})
    assert exact_dedup.keep_one(make([])).count() == 0


def near_copies(rng, n, length=60, changes=2):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [4, 512])
def test_near_groups_match_brute_force(make, chunk):
    rng = random.Random(9)
    texts = near_copies(rng, 40) + near_copies(rng, 15, 30, 1) + near_copies(rng, 30, 120, 6)
    texts += ["", "one two", "One  TWO", "one two three", " ", "one two three four five"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(500, None)]
    texts = [t for _, t in rows]
    got = {r.id: r for r in near_dup.near_groups(make(rows), chunk=chunk).collect()}
    links = brute.near(texts)
    n = [0] * len(texts)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert [got[i].n_links for i, _ in rows] == n
    label = {i: i for i in range(len(texts))}
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in label if label[b] == label[a]]
        assert got[i].class_id == max(ids) and got[i].group_size == len(ids)
        assert got[i].kept == (i == max(ids))


def test_near_odd_rows(make, odd):
    rows = near_dup.near_groups(make(odd)).collect()
    assert len(rows) == len(odd)
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert {r.class_id for r in by[5] + by[6] + by[7]} == {7}
    assert all(r.n_links == 3 for r in by[5] + by[6] + by[7])
    assert by[1][0].class_id == 2 and by[1][0].group_size == 3
    assert by[3][0].class_id == 4 and by[3][0].group_size == 4  # null, empty and white space
    kept = near_dup.keep_one(make(odd))
    assert kept.columns == make(odd).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "4", "7", "9", "10"])
    assert near_dup.near_groups(make([])).count() == 0
    assert near_dup.keep_one(make([])).count() == 0


def test_shingle_sets_agree_with_plain_python():
    rng = random.Random(2)
    words = ["a", "b", "Ä", "c.", "漢"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "  ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    plain, fast = [brute.shingles(t) for t in texts], [shingles.shingle_set(t) for t in texts]
    for a in range(0, 300, 3):
        for b in range(300):
            assert len(plain[a] & plain[b]) == len(set(fast[a].tolist()) & set(fast[b].tolist()))


def test_long_text_steps(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + " " + "y" * 300
    whole = shingles.shingle_set(text)
    monkeypatch.setattr(shingles, "_STEP", 64)
    assert (shingles.shingle_set(text) == whole).all()


def test_matched_depth_reaches_target():
    d = near_dup.matched_depth(0.8, 0.9999, 16, 6)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 16
    with pytest.raises(ValueError):
        near_dup.matched_depth(0.1, 0.9999, 2, 6)


def test_agreement_misses_a_hundredth_of_the_allowance():
    least = near_dup.agreement(0.8, 0.9999, 96)

    def below(n):
        return sum(math.comb(96, i) * 0.8**i * 0.2 ** (96 - i) for i in range(n))

    assert below(least) <= 1e-6 < below(least + 1)


def test_equal_values_follow_the_similarity():
    rng = np.random.default_rng(5)
    for shared in (0, 300, 800, 1000):  # of 1,000 in all, the rest half and half
        a = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        rest = (1000 - shared) // 2
        one, two = np.sort(a[: shared + rest]), np.sort(np.concatenate((a[:shared], a[shared + rest :])))
        equal = np.mean([shingles.minhash(one, 96, s) == shingles.minhash(two, 96, s) for s in range(40)])
        assert abs(equal - shared / 1000) < 0.03


def test_minhash_of_long_sets_in_steps(monkeypatch):
    values = shingles.shingle_set(" ".join(f"w{i}" for i in range(3000)))
    whole = shingles.minhash(values, 96)
    monkeypatch.setattr(shingles, "_COLUMNS", 7)
    assert (shingles.minhash(values, 96) == whole).all()


def test_blocks_run_on_over_batches():
    rows = pd.DataFrame({"t": 0, "h": [1, 2, 2, 2, 2, 3, 4, 4], "lo": 0, "hi": 0, "cid": range(8)})
    for size in (1, 2, 3, 8):
        batches = (rows.iloc[a : a + size] for a in range(0, 8, size))
        assert [(k[1], b["cid"].tolist()) for k, b in near_dup._blocks(batches)] == [(2, [1, 2, 3, 4]), (4, [6, 7])]


def test_open_pairs_by_hand():
    rng = np.random.default_rng(3)
    for n in (2, 9):
        for _ in range(60):
            labels = rng.integers(0, 2, (n, 4, near_dup.FULL_DEPTH)).astype(np.uint16)
            rows = {"labels": [x.tobytes() for x in labels], "side": rng.integers(0, 2, n)}
            for t in range(4):
                for lo, hi in ((0, 0), (0, 1)):
                    want = []
                    for a in range(n):
                        for b in range(a + 1, n):
                            met = [(labels[a, u, :2] == labels[b, u, :2]).all() for u in range(4)]
                            if (met[t] and not any(met[:t]) and (labels[a] == labels[b]).sum() >= 12
                                    and (lo == hi or rows["side"][a] != rows["side"][b])):
                                want.append((a, b))
                    left, right = near_dup._open_pairs((t, 0, lo, hi), rows, 4, 2, 12)
                    assert sorted(zip(left.tolist(), right.tolist())) == want


def test_pairs_at_the_threshold_are_found(make):
    """Pairs of similarity just above 0.8, each in a vocabulary of its own."""
    rows = []
    for p in range(150):
        words = [f"p{p}w{i}" for i in range(104)]  # 100 shingles, 89 of which are shared
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join([*words[:93], *[f"p{p}x{i}" for i in range(11)]]))]
    sets = [brute.shingles(t) for _, t in rows[:2]]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.81
    got = near_dup.near_groups(make(rows)).collect()
    assert all(r.n_links == 1 and r.class_id == r.id | 1 for r in got) and len(got) == 300


def test_components_on_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(edges.where("FALSE")).count() == 0
