import random

import corpus_pipeline
from scoreplane.llm import decontaminate, queries, toxicity
from scoreplane.llm.common import table
from scoreplane.llm import exact_dedup, mixing, near_dup
import brute


def test_registered_queries_match_their_sql(spark, sf_small):
    import duckdb
    from scoreplane.llm import oracle

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    for name, sql in oracle.ORACLE.items():
        got, want = queries.REGISTRY[name](spark, sf_small).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols

        def rows(d):
            return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d[cols].itertuples(index=False))

        assert rows(got) == rows(want), name


def test_pipeline_stages_take_effect(spark, sf_mid):
    """Each stage on all its predecessor kept, against plain Python from the texts the first stage kept."""
    documents = table(spark, sf_mid, "documents")
    docs = documents
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_mid)
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), documents.schema)
        kept.append({r.doc_id: r.text or "" for r in docs.collect()})
    model = toxicity.train(documents, table(spark, sf_mid, "labels"))
    toxic = {r.doc_id for r in toxicity.scores(documents, model).where("predicted = 1").collect()}
    full = {r.doc_id: r.text or "" for r in documents.collect()}
    assert set(kept[0]) == set(full) - toxic and toxic
    largest = {}
    for i, t in kept[0].items():
        largest[t] = max(i, largest.get(t, i))
    assert set(kept[1]) == set(largest.values())
    ids = sorted(kept[1])
    label = {i: i for i in ids}
    links = [(ids[a], ids[b]) for a, b in brute.near([kept[1][i] for i in ids])]
    for _ in ids:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = max(label[a], label[b])
        if before == label:
            break
    assert set(kept[2]) == {i for i in ids if label[i] == i}
    leaks = {r.doc_id for r in decontaminate.matches(documents, table(spark, sf_mid, "benchmark")).collect()}
    assert set(kept[3]) == set(kept[2]) - leaks
    mix = {r.doc_id: r for r in corpus_pipeline.mix(spark, docs, sf_mid).collect()}
    assert set(mix) == set(kept[3])
    run = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, sf_mid).collect()}
    assert run == {i: tuple(r) for i, r in mix.items()}


def test_stages_on_empty_and_odd_tables(spark, make, odd, sf_small):
    for rows in ([], odd):
        docs = make(rows, extra=False)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_small)
        assert docs.count() == len({r[1] or "" for r in rows}) - 2 * bool(rows) if rows else docs.count() == 0


def test_operators_survive_clashing_columns(make):
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choices(["a", "b", "c", "d"], k=20))) for n in range(20)]
    docs = make(rows)
    for op in (exact_dedup.exact_groups, near_dup.near_groups, mixing.mix_totals):
        assert op(docs).count() == 20
