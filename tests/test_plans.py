"""Plan-shape checks: what would hurt at scale must not appear in any registered query."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from scoreplane.plans.queries import REGISTRY

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]

def _explain(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cartesian_or_row_udf(spark, sf_small, name):
    plan = _explain(entry.queries()[name](spark, sf_small), "simple")
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


def test_flagship_prunes_columns(spark, sf_small):
    plan = _explain(entry.queries()["weighted_metrics"](spark, sf_small))
    # the generation scan reads only the stored parse, the mask columns and the record id - not the raw text
    assert ("ReadSchema: struct<property_id:bigint,dataset_idx:bigint,status_api_call:string,"
            "parsed:map<string,string>,status_geracao:string>") in plan
    # documents and labels: only the columns the truth fields use
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plan
    # one join of data-sized inputs (records x truth); the dimension join is a broadcast
    assert plan.count("- SortMergeJoin") == 1


def test_run_filter_prunes_partitions(spark, sf_small):
    from scoreplane.plans import evaluation as E

    plan = _explain(E.pairs(spark, sf_small).filter("model = 'beta-vl:13b' AND temperature = 0.5"))
    assert "PartitionFilters: [isnotnull(model" in plan and "(model#" in plan
    assert "(temperature#" in plan


def _ran(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_is_flattened_from_the_summary(spark, sf_small):
    plan = _ran(REGISTRY["flatten_reports"](spark, sf_small))
    final = plan[plan.index("== Final Plan ==") if "== Final Plan ==" in plan else 0:].split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") <= 5


def test_report_rows_has_no_unpartitioned_window(spark, sf_small):
    plan = _explain(REGISTRY["report_rows"](spark, sf_small), "simple")
    main = plan.split("Subquery")[0]
    assert "Exchange SinglePartition" not in main
