import os
import tempfile

from scoreplane.plans import adapters as A
from scoreplane.streaming.evaluate_stream import start_counts_stream, streaming_counts


def test_stream_counts_equal_batch(spark, sf_small):
    from scoreplane.plans import evaluation as E

    src = tempfile.mkdtemp(prefix="scoreplane-stream-src-")
    rec = A.generation_records(spark, sf_small)
    # two arrivals: first the 0.0 runs, then the rest
    rec.filter("temperature = 0.0").write.mode("append").parquet(src)
    truth = A.truth(spark, sf_small)
    counts = streaming_counts(spark, src, truth, A.FIELDS)
    ck = tempfile.mkdtemp(prefix="scoreplane-stream-ck-")
    q = start_counts_stream(counts, ck, sink_table="stream_counts")
    try:
        q.processAllAvailable()
        first = spark.sql("SELECT sum(n) FROM stream_counts").first()[0]
        rec.filter("temperature <> 0.0").write.mode("append").parquet(src)
        q.processAllAvailable()
        got = {tuple(r[:5]): r[5] for r in spark.sql("SELECT * FROM stream_counts").collect()}
    finally:
        q.stop()
    want = {tuple(r[:5]): r[5] for r in E.counts(spark, sf_small).collect()}
    assert first < sum(want.values())
    assert got == want


def test_stream_restarts_from_checkpoint(spark, sf_small):
    """A stopped query resumes from its checkpoint: state restored, no file counted twice."""
    from scoreplane.plans import evaluation as E

    src = tempfile.mkdtemp(prefix="scoreplane-stream-src-")
    ck = tempfile.mkdtemp(prefix="scoreplane-stream-ck-")
    rec = A.generation_records(spark, sf_small)
    truth = A.truth(spark, sf_small)
    rec.filter("temperature = 1.0").write.mode("append").parquet(src)
    q = start_counts_stream(streaming_counts(spark, src, truth, A.FIELDS), ck, sink_table="restart_a")
    q.processAllAvailable()
    q.stop()
    rec.filter("temperature <> 1.0").write.mode("append").parquet(src)
    q = start_counts_stream(streaming_counts(spark, src, truth, A.FIELDS), ck, sink_table="restart_b")
    try:
        q.processAllAvailable()
        got = {tuple(r[:5]): r[5] for r in spark.sql("SELECT * FROM restart_b").collect()}
    finally:
        q.stop()
    want = {tuple(r[:5]): r[5] for r in E.counts(spark, sf_small).collect()}
    assert got == want


def test_snapshots_are_published_whole(spark, sf_small, tmp_path):
    from scoreplane.streaming.evaluate_stream import latest_snapshot

    src, ck, out = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")
    records = A.build_generation_records(spark, sf_small)
    truth = A.truth(spark, sf_small)
    records.filter("model = 'alpha-vl:7b'").write.parquet(src)
    want = 0
    for step in range(3):
        if step:
            records.filter(f"model <> 'alpha-vl:7b' AND temperature = {step / 2}").write.mode("append").parquet(src)
        q = start_counts_stream(streaming_counts(spark, src, truth, A.FIELDS), ck, sink_path=out, trigger_once=True)
        q.awaitTermination(120)
        now = latest_snapshot(spark, out).agg({"n": "sum"}).first()[0]
        assert now > want and now % 4 == 0
        want = now
    assert len([n for n in (tmp_path / "out").iterdir() if n.name.startswith("batch=")]) == 2
