"""Stored tables must follow their inputs, requests and code."""

import os
import shutil
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from scoreplane.operators.generate import batch_generate
from scoreplane.operators.grid import experiment_grid, request_struct
from scoreplane.plans import adapters as A, queries as Q
from scoreplane.sources import tables


@pytest.fixture()
def own_copy(sf_small):
    d = tempfile.mkdtemp(prefix="scoreplane-test-")
    for t in ("documents", "labels", "conversations", "pages"):
        shutil.copy(f"{sf_small}/{t}.parquet", d)
    return d


def test_rewritten_documents_give_new_records(spark, own_copy, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert A.generation_records(spark, own_copy).count() == docs.count() * 9
    os.remove(f"{own_copy}/documents.parquet")
    docs.orderBy("doc_id").limit(50).write.parquet(f"{own_copy}/documents.parquet")
    assert A.generation_records(spark, own_copy).count() == 450
    assert Q.confusion_counts(spark, own_copy).agg(F.sum("n")).first()[0] == 1800
    docs.orderBy("doc_id").limit(10).write.mode("append").parquet(f"{own_copy}/documents.parquet")  # a file more
    assert A.generation_records(spark, own_copy).count() >= 450 + 90


def test_other_requests_and_code_make_another_table(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(request):
        calls.add(1)
        return {"response": "one"}

    def other(request):
        calls.add(1)
        return {"response": "two"}

    def out(models, generate):
        r = experiment_grid(spark.range(3).withColumnRenamed("id", "request_id"), models, [0.0]).select(
            "request_id", "model", request_struct(F.col("model"), F.lit(0.0), F.lit("s"), F.lit("p")).alias("request"))
        return A.cached_generation("test", r, generate, lambda q, g: batch_generate(q, g, 2))

    name = tempfile.mkdtemp()  # names of their own, so that an earlier run's tables are not met
    assert out([name, name + "b"], model).count() == 6
    assert out([name], model).count() == 3
    assert calls.value == 9
    assert out([name], model).count() == 3 and calls.value == 9  # stored: not called again
    assert {r[0] for r in out([name], other).select("raw_answer").collect()} == {"two"}


def test_no_half_written_table_is_served(spark, monkeypatch):
    df = spark.range(10).withColumn("x", F.lit(tempfile.mkdtemp()))
    first = tables.materialize(df, "half")
    path = os.path.dirname(first.inputFiles()[0].replace("file:", ""))
    assert first.count() == 10 and tables.materialize(df, "half").count() == 10
    siblings = [n for n in os.listdir(os.path.dirname(path)) if n.startswith(os.path.basename(path) + ".")]
    assert siblings == []  # attempts are renamed or dropped


def test_run_columns_keep_their_types(spark):
    df = spark.createDataFrame([("2024", 1), ("007", 2)], "model string, v int").withColumn("x", F.lit(tempfile.mkdtemp()))
    back = tables.materialize(df, "typed", partition_by=["model"])
    assert sorted(r["model"] for r in back.collect()) == ["007", "2024"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from scoreplane import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Fake:
        conf = Conf()
        sparkContext = property(lambda self: (_ for _ in ()).throw(RuntimeError()))

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake())


def test_rows_in_memory_give_their_own_tables(spark):
    a, b = (spark.createDataFrame([(n,)], "v int") for n in (1, 2))
    assert [r.v for r in tables.materialize(a, "memory").collect()] == [1]
    assert [r.v for r in tables.materialize(b, "memory").collect()] == [2]
    c, d = (spark.sql(f"SELECT * FROM VALUES ({n}), (9) AS t(v)") for n in (3, 4))
    assert sorted(r.v for r in tables.materialize(c, "memory").collect()) == [3, 9]
    assert sorted(r.v for r in tables.materialize(d, "memory").collect()) == [4, 9]


def test_wide_plans_that_differ_in_one_late_column(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")

    def wide(last):
        return docs.limit(1).select(*[F.lit(i).alias(f"c{i}") for i in range(39)], F.lit(last).alias("c39"))
    assert [tables.materialize(wide(x), "wide").first().c39 for x in ("a", "b", "a")] == ["a", "b", "a"]


def test_sides_of_a_join_and_columns_of_one_name(spark, sf_small):
    one, two = tempfile.mkdtemp(), tempfile.mkdtemp()
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string").write.mode("overwrite").parquet(one)
    spark.createDataFrame([(1, "z")], "k int, v string").write.mode("overwrite").parquet(two)
    a, b = spark.read.parquet(one), spark.read.parquet(two)
    assert tables.materialize(a.join(b, "k", "left_semi"), "sides").collect()[0].v == "x"
    assert tables.materialize(b.join(a, "k", "left_semi"), "sides").collect()[0].v == "z"
    j = a.join(b, a.k == b.k)
    assert tables.materialize(j.select(a.v), "named").first().v == "x"
    assert tables.materialize(j.select(b.v), "named").first().v == "z"


def test_the_same_plan_is_served_again_and_python_code_only_with_a_key(spark, sf_small):
    def docs():
        return spark.read.parquet(f"{sf_small}/documents.parquet").selectExpr(
            "doc_id", "FILTER(SPLIT(text, ' '), w -> w > 'm') AS w")
    assert tables.plan_fingerprint(docs()) == tables.plan_fingerprint(docs()) is not None
    mapped = docs().select("doc_id").mapInArrow(lambda batches: batches, "doc_id bigint")
    assert tables.plan_fingerprint(mapped) is None and tables.plan_fingerprint(mapped, code_is_told=True) is not None
    assert tables.plan_fingerprint(docs().withColumn("t", F.current_timestamp())) is None


def test_code_is_told_by_closures_and_helpers():
    def made(word, helper):
        def model(request):
            return {"response": helper(word)}
        return model

    def upper(x):
        return x.upper()

    def lower(x):
        return x.lower()
    assert tables.code_fingerprint(made("a", upper)) == tables.code_fingerprint(made("a", upper))
    assert len({tables.code_fingerprint(f) for f in (made("a", upper), made("b", upper), made("a", lower))}) == 3
    assert tables.code_fingerprint(made(object(), upper)) is None
    assert tables.code_fingerprint(Q.stub_generate) is not None


def test_a_changed_closure_gives_its_own_answers(spark):
    requests = spark.range(2).select(F.col("id").alias("request_id"), request_struct(
        F.lit(tempfile.mkdtemp()), F.lit(0.0), F.lit("s"), F.lit("p")).alias("request"))

    def answers(word):
        return {r.raw_answer for r in A.cached_generation(
            "closure", requests, lambda request: {"response": word}, lambda q, g: batch_generate(q, g, 2)).collect()}
    assert answers("one") == {"one"} and answers("two") == {"two"}


def test_a_local_session_without_a_checkpoint_setting():
    code = """
import sys; sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from scoreplane.session import ensure_checkpoint_dir
from scoreplane.sources import tables
assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
assert tables.materialize(spark.range(3), "own").count() == 3
""" % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    empty = tempfile.mkdtemp()
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"SPARK_CONF_DIR": empty}, timeout=300)
