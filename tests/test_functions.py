import json

import pytest
from pyspark.sql import functions as F

from scoreplane.functions import jsonx as JX
from scoreplane.functions import media as MD
from scoreplane.functions import text as TX
from scoreplane.functions.vectors import argmax, cosine_similarity


def one(spark, expr_fn, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr_fn(F.col("x"))).collect()]


def py_norm(s):
    return " ".join(str(s).lower().strip().split())


def test_normalize_matches_python_split(spark):
    vals = ["ALUMÍNIO ", " A\tB  ", "a b", "x  y", "p\x1cq", "\n\nz\r\n", "", "Ç Ã"]
    assert one(spark, TX.normalize_text, vals) == [py_norm(v) for v in vals]


def test_canonical_label(spark):
    vals = ["ALUMÍNIO ", "", "   ", None, " Very  Long "]
    assert one(spark, TX.canonical_label, vals) == ["alumínio", "na", "na", "na", "very long"]


def test_missing_tokens(spark):
    vals = ["NA", "None", "NULL", "nan", "", "Alvenaria"]
    assert one(spark, TX.missing_token_to_null, vals) == [None] * 5 + ["Alvenaria"]


def test_slug_and_safe_names(spark):
    assert one(spark, TX.slug, ["Instalação Elétrica", "Size Band"]) == ["Instalacao_Eletrica", "Size_Band"]
    assert one(spark, TX.safe_model_name, ["vlm3:27b", "org/model:1"]) == ["vlm3_27b", "org_model_1"]
    assert one(spark, TX.safe_temperature, [0.5, 1.0], "x double") == ["0p5", "1p0"]


def test_file_name_parse_keeps_model_p(spark):
    names = ["evaluation_metrics_vision-2.5-pro_temp_0p5.json", "evaluation_metrics_vlm3_12b_temp_1p0.json",
             "other.json"]
    assert one(spark, TX.model_from_file_name, names) == ["vision-2.5-pro", "vlm3:12b", None]
    assert one(spark, TX.temperature_from_file_name, names) == ["0.5", "1.0", None]


def test_fallbacks(spark):
    df = spark.createDataFrame([(0.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(TX.nonzero_or("a", "b")).collect()] == [5.0, 3.0, 5.0]


def test_to_number(spark):
    assert one(spark, TX.to_number, ["0.5", "N/A", "1e-3", None]) == [0.5, None, 0.001, None]


def test_fixed_is_half_even_on_binary_value(spark):
    vals = [0.125, 0.625, 0.615, 1234.5, 0.375]
    assert one(spark, lambda c: TX.fixed(c, 2), vals, "x double") == ["%.2f" % v for v in vals]


def test_fixed_prints_what_percent_f_prints(spark):
    vals = [0.12344999999999, 0.12345, 0.5, 2.675, 1e-9, 0.99995, 0.00015, 123456.78905, 0.615]
    assert one(spark, lambda c: TX.fixed(c, 4), vals, "x double") == ["%.4f" % v for v in vals]
    assert one(spark, lambda c: TX.fixed(TX.settled(c), 2), [0.1 + 0.2, 0.115000000000001], "x double") == ["0.30", "0.12"]


def test_escape_order(spark):
    got = one(spark, TX.escape_special, ["a & b % $ # _ { } ~ ^ \\"])[0]
    assert got == r"a \& b \% \$ \# \_ \{ \} \textasciitilde{} \^{} \textbackslash\{\}"
    assert one(spark, lambda c: TX.escape_special(c, True), ["vlm3_27b"]) == ["vlm3:27b"]


JSON_CASES = [
    ('{"a":"1"}', {"a": "1"}),
    ('text ```json\n{"a": "x"}\n``` later {"b": 2}', {"a": "x"}),
    ('{"a":1} tail }', None),
    ('{"a":1},{"b":2}', None),
    ('{"a":1,"a":2}', {"a": "2"}),
    ('{"a":"x\ny"}', None),
    ("{'a':1}", None),
    ('{"a":01}', None),
    ('{"a":1,}', None),
    ('{"a":\x01 1}', {"a": "1"}),
    ("", None),
    ("no braces here", None),
    (None, None),
]


def test_strict_json_extraction(spark):
    df = spark.createDataFrame([(c,) for c, _ in JSON_CASES], "x string")
    out = JX.with_extracted_json(df, "x").collect()
    for (raw, want), row in zip(JSON_CASES, out):
        got = dict(row["parsed"]) if row["parsed"] is not None else None
        assert got == want, raw
        assert (row["json_parsing_error_msg"] is None) == (want is not None), raw


@pytest.mark.parametrize("raw", [
    '{"a":1}]}', '{"a":1}]x{}', '{"a":1}] [{"b":2}', '{"a":1}]}]garbage}', '{"a":1}} x}', '{"a":1}}', '{"a":1},"w":{"b":1}', '{"a":1}, {}',
    '{"a":{"b":[1,2,{"c":null}]}}', '{"a":NaN}', '{"a":Infinity,"b":-Infinity}', '{"a":1}\n', '{"a":"]}"}', '{"a":[1}', '{"a":1e5}', '{"a":.5}',
    '{"a":+1}', '{"a":tru}', '{"a" 1}', '{"a":1;}', '{"a":"\\u00e9"}', '{"a":"\\x"}', '{"a":/*c*/1}', '{a:1}', '{"a":1}]}, {"v":{"a":1}'])
def test_strict_json_agrees_with_a_strict_reader(spark, raw):
    """The expected values come from Python's own reader on the candidate."""
    cand = raw[raw.index("{"): raw.rindex("}") + 1]
    try:
        want = json.loads(cand)
        ok = isinstance(want, dict) and bool(want)
    except ValueError:
        want, ok = None, False
    row = JX.with_extracted_json(spark.createDataFrame([(raw,)], "x string"), "x").first()
    assert (row["parsed"] is not None and len(row["parsed"]) > 0) == ok
    if ok:
        assert set(row["parsed"]) == set(want)


def test_empty_object_is_a_failure(spark):
    from scoreplane.operators.generate import parse_answers
    df = spark.createDataFrame([("{}", "sucesso"), ('{"a": "b"}', "sucesso"), (None, "falha")],
                               "raw_answer string, status_api_call string")
    st = [r["status_geracao"] for r in parse_answers(df).collect()]
    assert st == ["erro_parsing_json", "processado_com_sucesso", "erro_api"]


def test_media(spark):
    df = spark.createDataFrame([("dir/a/IMG_1.PNG", b"\x89PNG" * 100), ("x/photo.jpeg", b"abc")],
                               "p string, b binary")
    rows = df.select(MD.mime_type("p"), MD.basename("p"), MD.is_image_name("p"), MD.data_url("b", "p")).collect()
    assert rows[0][0] == "image/png" and rows[0][1] == "IMG_1.PNG" and rows[0][2]
    assert rows[1][0] == "image/jpeg"
    assert "\n" not in rows[0][3] and rows[0][3].startswith("data:image/png;base64,iVBOR")
    sus = df.select(MD.looks_like_base64(MD.data_url("b", "p")), MD.looks_like_base64("p")).collect()
    assert sus[0][0] is True and sus[0][1] is False and sus[1][0] is False


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([], [1.0]), ([0.0], [1.0])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine_similarity("a", "b")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-12 and got[2] is None and got[3] is None
    assert [r[0] for r in df.select(argmax("b")).collect()] == [1, 1, 0, 0]


def test_embed_texts_with_injected_encoder(spark):
    import numpy as np
    from scoreplane.operators.similarity import embed_texts

    def factory():
        def enc(texts):
            return np.array([[len(t), t.count("a") + 1.0] for t in texts])
        return enc

    df = spark.createDataFrame([(1, "  A  b "), (2, ""), (3, None)], "id long, t string")
    rows = {r["id"]: r["embedding"] for r in embed_texts(df, "t", factory).collect()}
    assert rows[1] == [3.0, 2.0] and rows[2] is None and rows[3] is None


def test_run_grid_end_to_end(spark):
    from scoreplane.operators.generate import run_grid
    from scoreplane.plans.queries import stub_generate

    items = spark.createDataFrame([(1, "1", "sys", "hello"), (2, "2", "sys", ""), (3, "3", "sys", "x"), (4, "4", "sys", "x")],
                                  "request_id long, entity_id string, system string, prompt string")
    dirs = spark.createDataFrame([("1_house",), ("2",), ("4",)], "dir_name string")
    names = ["/d/1_house/b.png", "/d/1_house/a.JPG", "/d/1_house/x.txt", "/d/2/a.png", "/d/4/readme.md"]
    files = spark.createDataFrame([(n, bytearray(b"x")) for n in names], "path string, content binary")
    seen = spark.sparkContext.accumulator(0)

    def generate(request):
        seen.add(1)
        assert request["options"]["temperature"] in ("0.0", "1.0") and request["images"][0].startswith("data:image/")
        return stub_generate(request)

    out = {(r["request_id"], r["temperature"]): r
           for r in run_grid(items, ["m:1", " "], [0.0, 1.0], generate, 4, dirs=dirs, files=files).collect()}
    st = {k: r["status_geracao"] for k, r in out.items()}
    assert st[(1, 0.0)] == "processado_com_sucesso"
    assert out[(1, 0.0)]["parsed"]["n_images"] == "2"
    assert st[(2, 1.0)] == "erro_api"
    assert st[(3, 0.0)] == "erro_diretorio_nao_encontrado"
    assert out[(3, 0.0)]["error_message"] == "Diretório para '3' não encontrado."
    assert st[(4, 0.0)] == "erro_api" and out[(4, 0.0)]["error_message"] == "Nenhuma imagem codificada para API."
    assert len(st) == 8 and seen.value == 4  # items without a directory or images are never sent


def test_calls_spread_over_the_requested_tasks(spark):
    import os

    from pyspark import TaskContext

    from scoreplane.operators.generate import batch_generate
    from scoreplane.operators.grid import request_struct
    from pyspark.sql import functions as F

    rows = spark.range(64).withColumn("request", request_struct(F.lit("m"), F.lit(0.0), F.lit("s"), F.lit("p")))
    out = batch_generate(rows, lambda r: {"response": f"{TaskContext.get().partitionId()}", "usage": {"pid": os.getpid()}}, 7)
    assert out.select("raw_answer").distinct().count() == 7 and out.count() == 64


def test_infinity_has_one_spelling_and_strings_may_hold_any(spark):
    import json

    from scoreplane.functions.jsonx import with_extracted_json
    texts = ['{"a":+Infinity}', '{"a":Infinity}', '{"a":-Infinity}', '{"a":INF}', '{"a":-INF}', '{"a":+INF}', '{"a":"+Infinity INF"}',
             '{"a \\" INF":1e+5}', '{"a":[1,+Infinity]}', '{"a":NaN}', '{"b":"\\\\","a":+Infinity}', '{"+Inf":2E+3,"k":"x"}']

    def strict(t):
        try:
            return isinstance(json.loads(t), dict)
        except ValueError:
            return False
    rows = with_extracted_json(spark.createDataFrame([(t,) for t in texts], "raw string"), "raw").collect()
    assert {r.raw: r.parsed is not None for r in rows} == {t: strict(t) for t in texts}


def test_latency_sketches_merge_and_keep_their_bound(spark):
    import math
    import random

    from scoreplane.operators import reports as R
    rng = random.Random(4)
    values = [rng.lognormvariate(0, 3) for _ in range(3000)] + [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(0, None)], "run int, latency_s double")
    merged = R.merge_sketches(R.latency_sketch(df, ["run"]), [])
    got = {r["quantile"]: r for r in R.sketch_quantiles(merged, [0.0001, 0.1, 0.5, 0.99, 1.0], []).collect()}
    for q, r in got.items():
        exact = sorted(values)[max(1, math.ceil(q * len(values))) - 1]
        assert r["n"] == len(values) and abs(r["value"] - exact) <= 0.0100001 * exact
    assert merged.count() < 1000
    whole = R.latency_sketch(df, [])
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, merged.collect()), key=str)


def test_grid_of_models_that_fit_a_pattern(spark):
    from scoreplane.operators.grid import experiment_grid
    rows = experiment_grid(spark.range(2), ["a:7b", "", "b:7b", "a:70b"], [0.0], pattern="^a:").collect()
    assert sorted({r.model for r in rows}) == ["a:70b", "a:7b"] and len(rows) == 4
