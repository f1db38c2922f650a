"""Parsing and checking of response texts, one case per branch."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.functions import answers as A
from tagloom.operators.answers import AnswerReader
from tagloom.spec import PromptSpec

SPEC = PromptSpec(columns=("A", "B"), rules={"valid_b": ["x", "y"]}, defaults={"A": "none", "B": "other"})
PAD = ("ERROR_BATCH_MISMATCH",) * 2
MISS = "ERROR_MISSING_KEY"

BATCHES = [
    ('[{"A":"p","B":"x"},{"A":"q","B":"y"}]', 2, [("p", "x"), ("q", "y")]),
    ('  {"A":"p","B":"x"}\n', 1, [("p", "x")]),
    ('  [{"A":"p","B":"x"}]　', 1, [("p", "x")]),
    ('{"A":"p","B":"x"}', 2, [("p", "x"), PAD]),
    ('{"results":[{"A":"p"}]}', 2, [(MISS, MISS), PAD]),
    ("[]", 2, [PAD, PAD]),
    ('[{"A":"p","B":"x"},{"A":"q","B":"y"},{"A":"r","B":"x"}]', 2, [("p", "x"), ("q", "y")]),
    ('[{"A":"p","B":"x"},{"A":"q","B":"y"},null]', 2, [("p", "x"), ("q", "y")]),
    ('[{"A":"p","B":"x"},{"A":"q","B":"y"},{"A":"q","B":3}]', 2, [("p", "x"), ("q", "y")]),
    ('Sure: [{"A":"p","B":"x"}] ok', 1, [("p", "x")]),
    ('Sure: {"A":"p","B":"x"} ok', 1, [("p", "x")]),
    ('see [1] {"A":"p","B":"x"}', 1, None),
    ('see [a] {"A":"p"}', 1, None),
    ('{"A":"p","B":"x"}\n{"A":"q","B":"y"}', 2, None),
    ('] {"A":"p","B":"x"} [', 1, None),
    ('[{"A":"p"},null]', 2, None),
    ("[1,2]", 2, None),
    ("12", 2, None),
    ('"s"', 1, None),
    ("null", 2, None),
    ("", 2, None),
    (None, 2, None),
    ('[{"A":"p","B":"x"},]', 1, None),
    ("[{'A':'p','B':'x'}]", 1, None),
    ('[{"A":"p","B":"x"}] // done', 1, [("p", "x")]),
    ('[{"A":"p","B":"x"}]]', 1, None),
    ('{"B":"x"}', 1, [(MISS, "x")]),
    ('{"A":"p","B":null}', 1, None),
    ('{"A":"p","B":3}', 1, None),
    ('{"A":"p","B":true}', 1, None),
    ('{"A":"p","B":["x"]}', 1, None),
    ('{"A":null,"B":"x"}', 1, [(None, "x")]),
    ('{"A":3,"B":"x"}', 1, [("3", "x")]),
    ('{"A":{"k":[1]},"B":"x"}', 1, [('{"k":[1]}', "x")]),
    ('{"A":"NOT_APPLICABLE","B":3}', 1, [("none", "other")]),
    ('{"A":"N","B":3}', 1, [("N", "-")]),
    ('{"A":"N","B":null}', 1, [("N", "-")]),
    ('{"A":"N"}', 1, [("N", MISS)]),
    ('{"A":"N","B":"-"}', 1, [("N", "-")]),
    ('{"A":"n","B":"x"}', 1, [("n", "x")]),
    ('{"A":"p","A":"q","B":"x"}', 1, [("q", "x")]),
    ('{"A":"p","B":"anything"}', 1, [("p", "anything")]),
    ('{"A":"p","B":""}', 1, [("p", "")]),
    ('{"a":"p","B":"x"}', 1, [(MISS, "x")]),
    ('{"A":"\\u00e9 \\"q\\"","B":"x"}', 1, [('é "q"', "x")]),
]

SINGLES = [
    ('{"A":"p","B":"x"}', ("p", "x")),
    ('Well: {"A":"p","B":"x"}!', ("p", "x")),
    ('see [a] {"A":"p","B":"x"}', ("p", "x")),
    ('[{"A":"p","B":"x"}]', None),
    ("[]", None),
    ("null", None),
    ("} {", None),
    ("no json", None),
]


def _read(spark, cases, kind):
    rows = [(i, text, list(range(n))) for i, (text, n) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, content string, ids array<int>")
    df = df.withColumn("rows", F.transform("ids", lambda x: F.struct(x.alias("id"))))
    out = {}
    for r in AnswerReader(SPEC, kind)(df).collect():
        out[r["i"]] = [(a["values"]["A"], a["values"]["B"]) for a in r["answers"]] if r["ok"] else None
    return out


def test_batch_answers(spark):
    got = _read(spark, [(text, n) for text, n, _ in BATCHES], "batch")
    wrong = [(BATCHES[i], got[i]) for i in range(len(BATCHES)) if got[i] != BATCHES[i][2]]
    assert not wrong


def test_single_answers(spark):
    got = _read(spark, [(text, 1) for text, _ in SINGLES], "row")
    wrong = [(SINGLES[i], got[i]) for i in range(len(SINGLES)) if got[i] != (SINGLES[i][1] and [SINGLES[i][1]])]
    assert not wrong


def test_strict_parse_agrees_with_python(spark):
    texts = ["{}", "[]", "1", "01", "1.5e3", "-", "true", "tru", '"a"', "'a'", "{} {}", "{}\n{}", "[1,]", "{\"a\":1,}",
             "[1] x", "x [1]", "{a:1}", "/*c*/1", "1//c", '"a\nb"', '"a\\nb"', "[[[]]]", "]", "[", "{}]", "{},{}", "1,2",
             "nul", "null ", "", '{"a":{"b":[1,{"c":null}]}}', '"\\ud83d\\ude00"', "1 2", '["end"]', '1,"end"]', "+1", ".5"]

    def python_takes(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", A.parse_strict(F.col("t")).isNotNull().alias("p")).collect()}
    assert {texts[i]: p for i, p in got.items()} == {t: python_takes(t) for t in texts}


def test_repair_comes_before_the_type_check(spark):
    spec = PromptSpec(columns=("Topic", "Comparative_Mention", "Competitor_Named", "Competitive_Position"),
                      rules={"competitor_named_options": ["Acme"], "valid_competitive_position": ["Better"]})
    texts = [
        ('{"Topic":"t","Comparative_Mention":"N","Competitor_Named":3,"Competitive_Position":4}', ("t", "N", "NONE", "-")),
        ('{"Topic":"t","Comparative_Mention":"Y","Competitor_Named":3,"Competitive_Position":"Better"}', None),
        ('{"Topic":"t","Comparative_Mention":"Y","Competitor_Named":"","Competitive_Position":"x"}', ("t", "Y", "Other", "x")),
        ('{"Topic":"t","Comparative_Mention":"?","Competitor_Named":"","Competitive_Position":"x"}', ("t", "?", "", "x")),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, content string")
    df = df.withColumn("rows", F.array(F.struct(F.lit(1).alias("id"))))
    for r in AnswerReader(spec, "row")(df).collect():
        assert (tuple(r["answers"][0]["values"]) if r["ok"] else None) == texts[r["i"]][1]


def test_odd_column_names(spark):
    spec = PromptSpec(columns=("a.b", 'c "d"', "e`f", "$['x']"))
    text = json.dumps({"a.b": "1", 'c "d"': "2", "e`f": "3", "$['x']": "4"})
    df = spark.createDataFrame([(text,)], "content string").withColumn("rows", F.array(F.struct(F.lit(1).alias("id"))))
    row = AnswerReader(spec, "row")(df).first()
    assert row["ok"] and tuple(row["answers"][0]["values"]) == ("1", "2", "3", "4")


def test_error_makes_a_response_unusable(spark):
    df = spark.createDataFrame([('{"A":"p","B":"x"}', "boom"), ('{"A":"p","B":"x"}', None)], "content string, error string")
    df = df.withColumn("rows", F.array(F.struct(F.lit(1).alias("id"))))
    assert [r["ok"] for r in AnswerReader(SPEC, "row")(df).orderBy("error").collect()] == [True, False]


@pytest.mark.parametrize("rules, expected", [
    ({"valid_b": ["1"], "valid_bs": ["2"]}, ("1",)),
    ({"valid_bs": ["2"], "b_valid": ["3"]}, ("2",)),
    ({"b_valid": ["3"], "b_options": ["4"]}, ("3",)),
    ({"b_options": ["4"]}, ("4",)),
    ({"valid_b": [], "b_options": ["4"]}, ()),
    ({"valid_B": ["5"]}, ()),
])
def test_rule_lookup(rules, expected):
    assert PromptSpec(columns=("B",), rules=rules).allowed("B") == expected


def test_spec_from_json():
    spec = PromptSpec.from_json('{"columns_to_code": ["A"], "not_applicable_defaults": {"A": "-", "Z": "z"}}')
    assert spec.output_columns == ("A", "Z") and spec.system_prompt == ""
    with pytest.raises(ValueError):
        PromptSpec.from_json("{}")
