import random

import pytest
from pyspark.sql import functions as F

from scoreplane.operators import classify
from scoreplane.operators.pairs import FieldSpec, field_dimension

VOCAB = ["a", "b", "NA"]
LABELS = sorted({"a", "b", "na", "na_item_invalido_ou_pulado", "na_falha_geracao_ou_parse"})


def brute(y_true, y_pred, labels=LABELS):
    """Reference semantics spelled out in plain Python."""
    n = len(y_true)
    acc = sum(t == p for t, p in zip(y_true, y_pred)) / n
    per, w = {}, 0
    sums = [0.0, 0.0, 0.0]
    for lab in labels:
        tp = sum(t == p == lab for t, p in zip(y_true, y_pred))
        st = sum(t == lab for t in y_true)
        sp = sum(p == lab for p in y_pred)
        pr = tp / sp if sp else 0.0
        rc = tp / st if st else 0.0
        f1 = 2 * tp / (sp + st) if sp + st else 0.0
        per[lab] = (pr, rc, f1, st, sp)
        w += st
        sums = [sums[0] + pr * st, sums[1] + rc * st, sums[2] + f1 * st]
    weighted = [s / w if w else 0.0 for s in sums]
    return acc, weighted, per


def run(spark, y_true, y_pred):
    rows = [("m", 0.0, "F", t, p) for t, p in zip(y_true, y_pred)]
    pairs = spark.createDataFrame(rows, "model string, temperature double, field string, y_true string, y_pred string")
    dim = field_dimension(spark, [FieldSpec("F", "f", VOCAB)])
    counts, pc, summ = classify.evaluate(pairs, dim)
    return summ.collect(), {r["label"]: r for r in pc.collect()}


CASES = {
    "C1": (["a", "a", "b"], ["a", "a", "b"]),
    "C2": (["a", "a", "b"], ["a", "b", "b"]),
    "C3": (["a", "a"], ["a", "zzz"]),
    "C4": (["zzz", "a"], ["zzz", "a"]),
    "C5": (["a", "a"], ["b", "b"]),
    "C6": (["na", "a"], ["na", "a"]),
    "C7": (["a"], ["na_falha_geracao_ou_parse"]),
    "C8": (["na_item_pulado", "a"], ["na_item_pulado", "a"]),
    "C9": (["zzz"], ["zzz"]),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_cases_match_brute_force(spark, case):
    yt, yp = CASES[case]
    summ, per = run(spark, yt, yp)
    acc, weighted, bper = brute(yt, yp)
    assert len(summ) == 1
    s = summ[0]
    assert s["accuracy"] == pytest.approx(acc)
    assert [s["precision_weighted"], s["recall_weighted"], s["f1_score_weighted"]] == pytest.approx(weighted)
    assert set(per) == set(LABELS)
    for lab, (pr, rc, f1, st, sp) in bper.items():
        r = per[lab]
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((pr, rc, f1))
        assert (r["support_true"], r["support_pred"]) == (st, sp)


def test_c3_oov_prediction_counts_nowhere(spark):
    _, per = run(spark, ["a", "a"], ["a", "zzz"])
    assert sum(r["support_pred"] for r in per.values()) == 1


def test_c10_empty_input_no_rows_no_error(spark):
    summ, per = run(spark, [], [])
    assert summ == [] and per == {}


def test_properties_random(spark):
    rnd = random.Random(7)
    labels = ["a", "b", "na"]
    yt = [rnd.choice(labels) for _ in range(300)]
    yp = [rnd.choice(labels + ["zzz"]) for _ in range(300)]
    summ, per = run(spark, yt, yp)
    s = summ[0]
    # truth all in vocabulary -> weighted recall equals accuracy
    assert s["recall_weighted"] == pytest.approx(s["accuracy"])
    assert s["n_items"] == 300
    # permutation invariance
    idx = list(range(300))
    rnd.shuffle(idx)
    summ2, _ = run(spark, [yt[i] for i in idx], [yp[i] for i in idx])
    assert summ2[0]["f1_score_weighted"] == pytest.approx(s["f1_score_weighted"])


def test_confusion_counts_sum_and_pivot(spark):
    yt, yp = ["a", "a", "b", "na"], ["a", "b", "b", "zzz"]
    rows = [("m", 0.0, "F", t, p) for t, p in zip(yt, yp)]
    pairs = spark.createDataFrame(rows, "model string, temperature double, field string, y_true string, y_pred string")
    dim = field_dimension(spark, [FieldSpec("F", "f", VOCAB)])
    counts = classify.confusion_counts(pairs)
    assert counts.agg(F.sum("n")).first()[0] == 4
    m = {r["y_true"]: r for r in classify.confusion_matrix(pairs, FieldSpec("F", "f", VOCAB)).collect()}
    assert (m["a"]["a"], m["a"]["b"], m["b"]["b"], m["na"]["na"]) == (1, 1, 1, 0)
    assert set(m) == set(LABELS)  # zero-filled truth rows


def test_macro_and_overall(spark):
    rows = [("m", 0.0, f, t, p) for f in ["F", "G"] for t, p in [("a", "a"), ("b", "a")]]
    pairs = spark.createDataFrame(rows, "model string, temperature double, field string, y_true string, y_pred string")
    dim = field_dimension(spark, [FieldSpec("F", "f", VOCAB), FieldSpec("G", "g", VOCAB)])
    _, _, summ = classify.evaluate(pairs, dim)
    macro = classify.macro_average(summ).first()
    assert macro["n_categories"] == 2 and macro["accuracy"] == pytest.approx(0.5)
    ov = classify.summary_with_overall(summ).collect()
    assert sorted(r["category"] for r in ov) == sorted(["F", "G", "MÉDIA GERAL (Categorias)"])


def _counts(spark, rows):
    return spark.createDataFrame(rows, "model string, temperature double, field string, y_true string, y_pred string, n long")


def test_many_answers_fold_into_one_bucket(spark):
    """1e5 distinct answers and 100 labels: rows of counts + labels, not their product."""
    labels = [f"l{i}" for i in range(100)]
    one = spark.createDataFrame([("m", 0.0, "F")], "model string, temperature double, field string")
    counts = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(99_999))).alias("id")).selectExpr("model", "temperature", "field",
                                             "concat('l', id % 100) AS y_true", "concat('open ', id) AS y_pred", "1L AS n")
    dim = field_dimension(spark, [FieldSpec("F", "f", labels)])
    lt = classify.label_table(counts, dim)
    rows = lt.collect()
    assert len(rows) == 100 + 2 + 1  # vocabulary, placeholders, one bucket
    assert sum(r["support_pred"] for r in rows if not r["in_vocab"]) == 100_000
    s = classify.summary_from_labels(lt).first()
    assert s["n_oov_pred"] == 100_000 and s["accuracy"] == 0.0 and s["n_items"] == 100_000
    plan = lt._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_vocabulary_falls_back_to_observed_labels(spark):
    counts = _counts(spark, [("m", 0.0, "F", "a", "a", 2), ("m", 0.0, "F", "b", "a", 1), ("m", 0.0, "G", "x", "x", 1)])
    for dim in ([FieldSpec("F", "f", [])], []):
        d = field_dimension(spark, [*dim, FieldSpec("G", "g", ["x"])])
        s = {r["field"]: r for r in classify.summary(counts, d).collect()}
        assert s["F"]["accuracy"] == pytest.approx(2 / 3)
        assert s["F"]["recall_weighted"] == pytest.approx(2 / 3) and s["F"]["precision_weighted"] == pytest.approx(4 / 9)
        assert s["F"]["error"] is None and s["G"]["f1_score_weighted"] == 1.0


def test_expected_field_without_pairs_gives_an_error_row(spark):
    counts = _counts(spark, [("m", 0.0, "F", "a", "a", 2)])
    dim = field_dimension(spark, [FieldSpec("F", "f", ["a"]), FieldSpec("G", "g", ["x"])])
    expected = spark.createDataFrame([("m", 0.0, "F"), ("m", 0.0, "G")], "model string, temperature double, field string")
    s = {r["field"]: r for r in classify.summary(counts, dim, expected=expected).collect()}
    assert s["G"]["error"] == "Listas de entrada vazias." and s["G"]["n_items"] == 0 and s["F"]["error"] is None
    assert classify.macro_average(classify.summary(counts, dim, expected=expected)).first()["n_categories"] == 1
