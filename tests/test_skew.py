"""Hot keys: a third of the records without an index, and one index shared by many."""

import pytest
from pyspark.sql import functions as F

from scoreplane.operators import classify
from scoreplane.operators.pairs import FieldSpec, align_pairs, field_dimension, skipped_counts

FIELDS = [FieldSpec("F", "gt_f", ["a", "b"])]


def _records(spark, n=3000, bad=None):
    rows = []
    for i in range(n):
        idx = bad if i % 3 == 0 else (7 if i % 3 == 1 else i)   # 1/3 without a valid index, 1/3 on key 7
        rows.append(("m", 0.0, i, idx, "processado_com_sucesso", "sucesso", {"F": "a" if i % 2 else "b"}))
    return spark.createDataFrame(rows, "model string, temperature double, property_id long, dataset_idx long, "
                                       "status_geracao string, status_api_call string, parsed map<string,string>")


@pytest.mark.parametrize("bad", [None, -1])
def test_invalid_keys_spread_and_results_whole(spark, bad):
    # force the shuffle join the plan would use at scale
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.coalescePartitions.enabled")
    saved = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    # keep every shuffle partition visible (tiny test data would be coalesced into one)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(spark, bad)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _check(spark, bad):
    rec = _records(spark, bad=bad)
    truth = spark.range(0, 3000).select(F.col("id").alias("item_id"), F.lit("a").alias("gt_f"))
    pairs = align_pairs(rec, truth, FIELDS)
    assert "SortMergeJoin" in pairs._jdf.queryExecution().executedPlan().toString()
    # every record is kept: nothing dropped to escape skew
    assert pairs.count() == 3000
    skipped = pairs.filter("is_skipped")
    assert skipped.count() == 1000
    # the null-key third is not funnelled into one shuffle partition
    parts = skipped.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 4  # of 8 shuffle partitions; without the spread value they would share one
    lost = skipped_counts(rec, truth)
    assert lost.first()["n_skipped"] == 1000
    assert "SortMergeJoin" in lost._jdf.queryExecution().executedPlan().toString()
    dim = field_dimension(spark, FIELDS)
    s = classify.summary(classify.confusion_counts(pairs), dim).first()
    # 1000 skipped (correct under the reference rule) + key 7 and others: truth 'a', prediction a/b alternating
    keyed = rec.filter("dataset_idx >= 0").withColumn("ok", F.col("parsed")["F"] == "a")
    want = (1000 + keyed.filter("ok").count()) / 3000
    assert abs(s["accuracy"] - want) < 1e-12
