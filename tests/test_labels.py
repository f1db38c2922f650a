from pyspark.sql import functions as F

from tagloom.functions import labels as L
from tagloom.functions import text as T


def _apply(spark, rows, columns, rules):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    out = L.apply_rules({c: F.col(c) for c in columns}, rules)
    return [tuple(r) for r in df.select(*[out[c].alias(c) for c in columns]).collect()]


def test_label_classes(spark):
    cases = {"x": "valid", "ERROR_Z": "error", "[Z]": "bracketed", "[": "unexpected", "[]": "bracketed", "-": "marker",
             "NONE": "marker", "Unknown": "marker", "": "marker", "Zed": "organic", "a_b": "organic", "Éa": "organic",
             "zed": "unexpected", "7A": "unexpected", "ßa": "unexpected", "none": "unexpected", None: "untyped"}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    got = {r["v"]: r["c"] for r in df.select("v", L.label_class(F.col("v"), ["x", "y"]).alias("c")).collect()}
    assert got == cases
    listed = df.select("v", L.label_class(F.col("v"), F.array(F.lit("x"))).alias("c"))
    assert {r["v"]: r["c"] for r in listed.collect()} == cases
    assert {r["c"] for r in df.select(L.label_class(F.col("v"), []).alias("c")).collect()} == {"unchecked"}


def test_comparative(spark):
    rows = [("Y", "NONE", "p"), ("Y", "Acme", "p"), ("N", "Acme", "Better"), ("?", "-", "p"), (None, "-", "p"),
            ("Y", None, "p"), ("N", None, None)]
    rules = L.comparative_rules("f", "n", "p")
    assert _apply(spark, rows, ["f", "n", "p"], rules) == [
        ("Y", "Other", "p"), ("Y", "Acme", "p"), ("N", "NONE", "-"), ("?", "-", "p"), (None, "-", "p"),
        ("Y", None, "p"), ("N", "NONE", "-")]
    assert _apply(spark, [("N", "Acme")], ["f", "n"], rules) == [("N", "NONE")]
    assert _apply(spark, [("N", "Better")], ["f", "p"], rules) == [("N", "Better")]


def test_gate_comes_first(spark):
    columns = ["Comparative_Mention", "Competitor_Named"]
    rules = (L.gate_rule(columns), *L.STANDARD_RULES)
    assert _apply(spark, [("N", "Acme"), ("Y", "")], columns, rules) == [("N", "-"), ("Y", "Other")]


def test_abandonment(spark):
    assert _apply(spark, [("N", "price"), ("N", None), ("Y", "price")], ["f", "r"], L.abandonment_rules("f", "r")) == [
        ("N", "NONE"), ("N", "NONE"), ("Y", "price")]


def test_durations(spark):
    df = spark.createDataFrame([(59.9,), (3599.0,), (3600.0,), (0.0,), (360000.5,)], "s double")
    assert [r[0] for r in df.select(T.format_duration(F.col("s"))).collect()] == [
        "00:59", "59:59", "01:00:00", "00:00", "100:00:00"]


def test_names(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    none = F.lit(None).cast("string")
    assert value(T.model_tag(F.lit(7), F.lit("x"))) == "m7"
    assert value(T.model_tag(none, F.lit("gpt-oss:20b-cloud"))) == "mgptoss20bc"
    assert value(T.model_tag(none, F.lit("--"))) == "munknown"
    assert value(T.run_id(F.lit("my project!"), F.lit("v1.0"), F.lit("m7"), F.lit("20250101_000000"))) == \
        "my_project__v1_0_m7_20250101_000000"
    # A field value that looks like a field is left alone.
    assert value(T.output_name("{project}{{x}}_{label}", F.lit(3), project=F.lit("{label}"), label=F.lit("l"))) == \
        "{label}{x}_l_w3.csv"
    assert value(T.part_name(F.lit("j"), F.lit(7))) == "checkpoint_j_part0007"
    assert value(T.part_name(F.lit("j"), F.lit(12345))) == "checkpoint_j_part12345"
    assert value(T.metric_key(F.lit("Key_Point"), F.lit("a b-c"))) == "keypoint_a_b_c"
    assert value(T.title_clause(F.lit(" t "))) == "Title:  t \n"
    for blank in ("", "  ", "nan"):
        assert value(T.title_clause(F.lit(blank))) == ""
