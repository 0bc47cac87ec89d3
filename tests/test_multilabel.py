import pytest

from scoreplane.operators import multilabel as ML

V = ["p", "q", "r"]


def items(spark, rows):
    return spark.createDataFrame(rows, "y_true array<string>, y_pred array<string>")


def test_m1_micro(spark):
    s = ML.score_row(items(spark, [(["p", "q"], ["p"])]), V).first()
    assert s["precision_micro"] == 1.0 and s["recall_micro"] == 0.5


def test_m2_m3_m4_subset(spark):
    s = ML.score_row(items(spark, [([], []), (["p"], ["p", "zzz"]), (["p"], ["P", " p "])]), V).first()
    assert s["accuracy_subset"] == 1.0 and s["n_items"] == 3


def test_m5_no_items_all_one(spark):
    s = ML.score_row(items(spark, []), V).first()
    assert s["n_items"] == 0 and s["f1_score_macro"] == 1.0 and s["accuracy_subset"] == 1.0 and s["note"]


def test_per_label_2x2(spark):
    pl = {r["label"]: r for r in ML.per_label(items(spark, [(["p", "q"], ["p", "r"]), (["q"], [])]), V).collect()}
    assert (pl["p"]["tp"], pl["p"]["fp"], pl["p"]["fn"], pl["p"]["tn"]) == (1, 0, 0, 1)
    assert (pl["q"]["tp"], pl["q"]["fn"], pl["r"]["fp"]) == (0, 2, 1)
    mm = ML.micro_macro(items(spark, [(["p", "q"], ["p", "r"]), (["q"], [])]), V).first()
    assert mm["precision_macro"] == pytest.approx((1.0 + 0.0 + 0.0) / 3)


def test_capitalised_unsorted_vocabulary(spark):
    from scoreplane.operators import multilabel as ML

    items = spark.createDataFrame([(["piscina"], ["PISCINA "]), (["Sauna", "piscina"], ["sauna"])],
                                  "y_true array<string>, y_pred array<string>")
    for vocab in (["Sauna", "Piscina"], ["piscina", "sauna"], [" SAUNA", "Piscina", "sauna"]):
        r = ML.score_row(items, vocab).first()
        assert r["f1_score_micro"] == pytest.approx(0.8) and r["accuracy_subset"] == 0.5
        assert ML.subset_accuracy(items, vocab).first()["accuracy_subset"] == 0.5
        assert {x["label"]: (x["tp"], x["fn"]) for x in ML.per_label(items, vocab).collect()} == {"piscina": (1, 1), "sauna": (1, 0)}
