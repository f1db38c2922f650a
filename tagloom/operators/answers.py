"""From response texts to row answers, staged so that every text is parsed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.labels import STANDARD_RULES, Rule
from ..functions.text import stripped
from ..session import prepare
from ..spec import RETRIES_FAILED, PromptSpec


Stages = list[tuple[str, Column]]


def add_stages(df: DataFrame, stages: Stages) -> DataFrame:
    """Add columns one projection after the other, so that a later one reads an earlier one and does not repeat it."""
    for name, column in stages:
        df = df.select("*", column.alias(name))
    return df


def parse_stages(kind: str, content: str = "content") -> Stages:
    """``elements`` of each answer as ``array<variant>``, NULL where the text cannot be used.

    The strict parse of the whole text comes first; only where it failed, the slice that the text's brackets allow is
    parsed. A single-row answer must be one object.
    """
    candidate = A.array_candidate if kind == "batch" else A.object_candidate
    value = F.col("_value")
    elements = A.elements_of(value) if kind == "batch" else F.when(value.isNotNull(), F.array(value))
    clean, again = F.col("_clean"), F.col("_slice")
    return [
        ("_clean", stripped(F.col(content))),
        ("_whole", A.wrapped(clean)),
        ("_first", A.unwrapped(F.col("_whole"), clean)),
        ("_slice", F.when(F.col("_first").isNull(), candidate(clean))),
        ("_second", A.wrapped(again)),
        ("_value", F.coalesce("_first", A.unwrapped(F.col("_second"), again))),
        ("elements", elements),
    ]


def pairs_column(rows: str = "rows", elements: str = "elements") -> Column:
    """The i-th row with the i-th element: missing elements are NULL, surplus ones are dropped.

    NULL elements is a failed answer and stays NULL. A JSON ``null`` element is a variant null, so it is not padding.
    """
    pairs = F.zip_with(rows, elements, lambda r, e: F.struct(r.alias("row"), e.alias("element")))
    return F.slice(pairs, F.lit(1), F.size(rows))


def answers_column(spec: PromptSpec, rules: tuple[Rule, ...] = STANDARD_RULES, pairs: str = "pairs") -> Column:
    """Pairs as array of struct(row, values, ok).

    Every row meets its element inside one projection, so the all-or-nothing decision needs no shuffle. Each step is a
    ``transform`` of its own to have every key map and every text made once per element.
    """
    def keys(p):
        return F.when(p["element"].isNull(), A.pad_keys(spec)).otherwise(A.as_object(p["element"]))

    keyed = F.transform(pairs, lambda p: F.struct(p["row"].alias("row"), keys(p).alias("keys")))
    raw = F.transform(keyed, lambda k: F.struct(
        k["row"].alias("row"), k["keys"].isNotNull().alias("is_object"), A.raw_values(k["keys"], spec).alias("raw")))
    settled = F.transform(raw, lambda r: F.struct(
        r["row"].alias("row"), r["is_object"].alias("is_object"), A.settle(r["raw"], spec, rules).alias("s")))
    return F.transform(settled, lambda s: F.struct(
        s["row"].alias("row"), s["s"]["values"].alias("values"), (s["is_object"] & s["s"]["ok"]).alias("ok")))


class AnswerReader:
    """Reads responses of one kind (``batch`` or ``row``): ``answers`` and ``ok`` from ``content`` and ``rows``.

    The columns depend on the spec only; a reader is made once and used for every wave.
    """

    def __init__(self, spec: PromptSpec, kind: str = "batch", rules: tuple[Rule, ...] = STANDARD_RULES):
        self.parse = parse_stages(kind)
        self.pair = [("pairs", pairs_column())]
        usable = F.forall("answers", lambda a: a["ok"])
        self.check = [("answers", answers_column(spec, rules)), ("ok", F.coalesce(usable, F.lit(False)))]
        self.without_error = F.col("ok") & F.col("error").isNull()

    def elements(self, responses: DataFrame) -> DataFrame:
        """Responses with their ``elements``."""
        prepare(responses.sparkSession)
        return add_stages(responses, self.parse).select(*responses.columns, "elements")

    def __call__(self, responses: DataFrame) -> DataFrame:
        """Responses with ``answers`` and ``ok``; a response with an ``error`` is not ok."""
        prepare(responses.sparkSession)
        checked = add_stages(responses, self.parse + self.pair + self.check)
        ok = self.without_error if "error" in responses.columns else F.col("ok")
        return checked.select(*responses.columns, "answers", ok.alias("ok"))


def coded_rows(responses: DataFrame, spec: PromptSpec, keep: Sequence[str] = ("RowID", "Sentiment"),
               carry: Sequence[str] = ()) -> DataFrame:
    """One row per answered message of usable responses: ``keep`` of the message, then the coded columns."""
    # Not a filter on "ok": where answers are not read from a table it would be pushed below and repeat all the parsing
    # that "ok" stands for. The outer form keeps Spark from adding such a filter itself.
    exploded = responses.select(*carry, F.inline_outer(F.when(F.col("ok"), F.col("answers"))))
    exploded = exploded.filter(F.col("row").isNotNull())
    names = output_names(spec, keep)
    return exploded.select(
        *carry, *[F.col("row").getField(k).alias(k) for k in keep],
        *[F.col("values").getField(c).alias(n) for c, n in names.items()])


def output_names(spec: PromptSpec, keep: Sequence[str]) -> dict[str, str]:
    """Names of the coded columns in the output; one that meets a kept input column gets a prefix."""
    return {c: f"Validated_{c}" if c in keep else c for c in spec.output_columns}


def terminal_fill(rows: DataFrame, spec: PromptSpec, keep: Sequence[str] = ("RowID", "Sentiment"),
                  carry: Sequence[str] = ()) -> DataFrame:
    """Rows that ran out of attempts: every coded column holds the failure marker."""
    names = output_names(spec, keep)
    values = [(F.lit(RETRIES_FAILED) if c in spec.columns else F.lit(None).cast("string")).alias(n)
              for c, n in names.items()]
    return rows.select(*carry, *keep, *values)


def zip_results(messages: DataFrame, answers: DataFrame, keep: Sequence[str] = ("RowID", "Sentiment")) -> DataFrame:
    """Messages next to their answers, matched by RowID and never by partition order."""
    return messages.select(*keep).join(answers, "RowID")
