"""A restarted generation job never repeats an answered call."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreplane.operators import ledger
from scoreplane.operators.grid import request_struct


def _requests(spark, n, model="m", prompt="p"):
    return spark.range(n).select(F.col("id").alias("request_id"), F.lit(model).alias("model"), request_struct(
        F.lit(model), F.lit(0.0), F.lit("s"), F.concat(F.lit(prompt), F.col("id").cast("string"))).alias("request"))


def _counting(folder, dies_after=None):
    def generate(request):
        prompt, log = request["prompt"], os.path.join(folder, "calls")
        with open(log, "a") as f:
            f.write(f"{request['model']}:{prompt}\n")
        if dies_after and len(open(log).readlines()) > dies_after:
            os._exit(1)  # the worker dies as a lost executor does
        return {"error": "no"} if prompt == "p3" else {"response": f"answer {prompt}", "latency_s": 0.0}
    return generate


def _calls(folder):
    with open(os.path.join(folder, "calls")) as f:
        return Counter(f.read().split())


def test_a_job_killed_half_way_resumes(spark):
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "ledger")
    requests = _requests(spark, 120)
    with pytest.raises(Exception):
        ledger.resume(requests, _counting(folder, 60), path, "first", calls_per_task=2).count()
    stored = {r.request_id for r in ledger.answers(requests, path).collect()}
    assert 20 < len(stored) < 120  # what finished tasks have answered is there
    out = ledger.resume(requests, _counting(folder), path, "second", calls_per_task=2).collect()
    assert sorted(r.request_id for r in out) == list(range(120))
    calls = _calls(folder)
    assert all(calls[f"m:p{i}"] == 1 for i in stored) and set(calls) == {f"m:p{i}" for i in range(120)}
    assert {r.request_id for r in out if r.job == "first"} == stored
    assert {r.request_id: r.raw_answer for r in out}[7] == "answer p7"
    ledger.resume(requests, _counting(folder), path, "third").count()
    assert _calls(folder) == calls  # nothing is left to call


def test_larger_grids_changed_prompts_and_retries(spark):
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "ledger")
    first = _requests(spark, 5)
    assert ledger.answers(first, path).count() == 0
    ledger.resume(first.unionByName(first), _counting(folder), path, "a").count()  # equal requests are one call
    both = first.unionByName(_requests(spark, 5, "n"))
    rows = ledger.resume(both, _counting(folder), path, "b").collect()
    assert Counter((r.model, r.job) for r in rows) == {("m", "a"): 5, ("n", "b"): 5}
    assert max(_calls(folder).values()) == 1
    assert Counter(r.job for r in ledger.resume(_requests(spark, 5, prompt="q"), _counting(folder), path, "c").collect()) == {"c": 5}
    assert {(r.model, r.n_calls, r.n_failed) for r in ledger.failed_calls(ledger.answers(both, path)).collect()} == {
        ("m", 5, 1), ("n", 5, 1)}

    def works(request):
        return {"response": "now", "latency_s": 0.0}
    again = {r.request_id: r for r in ledger.resume(first, works, path, "d", retry_failed=True).collect()}
    assert again[3].raw_answer == "now" and again[3].job == "d" and again[2].job == "a" and len(again) == 5
