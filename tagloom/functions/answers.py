"""Parsing and checking of model answers as Column expressions over VARIANT.

The expressions here are the pieces; ``operators.answers`` puts them together in stages so that a text is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import BATCH_MISMATCH, MISSING_KEY, NOT_APPLICABLE, PromptSpec
from .labels import STANDARD_RULES, Rule, apply_rules, gate_rule
from .text import stripped

def _mark(text: Column) -> Column:
    """Number that a text does not contain by chance."""
    return F.xxhash64(text)


def wrapped(text: Column) -> Column:
    """``[<text>,<mark>]`` parsed; only a text that is one JSON value leaves the mark in second place.

    ``try_parse_json`` alone accepts more text behind the value.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), _mark(text).cast("string"), F.lit("]")))


def unwrapped(value: Column, text: Column) -> Column:
    """The value in a wrapped text, NULL if there was not exactly one. A JSON ``null`` is a variant null, not NULL."""
    alone = F.try_variant_get(value, "$[1]", "long") == _mark(text)
    return F.when(alone, F.try_variant_get(value, "$[0]", "variant"))


def parse_strict(text: Column) -> Column:
    """The whole text as one JSON value, else NULL."""
    return unwrapped(wrapped(text), text)


def has_pair(text: Column, opening: str, closing: str) -> Column:
    return F.contains(text, F.lit(opening)) & F.contains(text, F.lit(closing))


def outer_slice(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket; empty when they are the wrong way round."""
    start = F.instr(text, opening)
    after = F.length(F.substring_index(text, closing, -1))
    return F.substring(text, start, F.length(text) - after - start + 1)


def object_candidate(text: Column) -> Column:
    """Second try for a single answer: the text between the outer braces."""
    return F.when(has_pair(text, "{", "}"), outer_slice(text, "{", "}"))


def array_candidate(text: Column) -> Column:
    """Second try for a batch answer: the outer square brackets decide alone if both are there, else the outer braces."""
    return F.when(has_pair(text, "[", "]"), outer_slice(text, "[", "]")).otherwise(object_candidate(text))


def parse_object(text: Column) -> Column:
    """Strict parse, else the text between the outer braces."""
    clean = stripped(text)
    return F.coalesce(parse_strict(clean), parse_strict(object_candidate(clean)))


def parse_array(text: Column) -> Column:
    """Elements of a batch answer, NULL when it cannot be used."""
    clean = stripped(text)
    return elements_of(F.coalesce(parse_strict(clean), parse_strict(array_candidate(clean))))


def as_object(value: Column) -> Column:
    """Keys and values of a JSON object; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements_of(value: Column) -> Column:
    """A JSON array as ``array<variant>``, an object as its only element, NULL for anything else."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(listed, F.when(as_object(value).isNotNull(), F.array(value)))


def value_text(value: Column) -> Column:
    """Text of a JSON value: strings as they are, other values in JSON form, ``null`` as NULL."""
    return F.try_variant_get(value, "$", "string")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def coded_text(keys: Column, column: str) -> Column:
    """Value of one coded column; a missing key is marked, a JSON null stays NULL."""
    value = F.try_element_at(keys, F.lit(column))
    return F.when(value.isNull(), F.lit(MISSING_KEY)).otherwise(value_text(value))


def not_applicable(first_value: Column) -> Column:
    return F.coalesce(first_value == NOT_APPLICABLE, F.lit(False))


def apply_defaults(values: dict[str, Column], spec: PromptSpec) -> dict[str, Column]:
    """Rows marked as not applicable take the defaults map as it is; a column without default becomes NULL."""
    skip = not_applicable(values[spec.first])
    nothing = F.lit(None).cast("string")
    return {
        c: F.when(skip, F.lit(spec.defaults.get(c)).cast("string")).otherwise(values.get(c, nothing))
        for c in spec.output_columns
    }


def pad_keys(spec: PromptSpec) -> Column:
    """Stands for an element that the answer did not deliver."""
    text = F.try_parse_json(F.lit(f'"{BATCH_MISMATCH}"'))
    return F.map_from_arrays(F.array(*[F.lit(c) for c in spec.columns]), F.array_repeat(text, len(spec.columns)))


def raw_values(keys: Column, spec: PromptSpec) -> Column:
    """struct(values, typed): text per coded column, and whether each ruled column holds text or is missing."""
    texts = [coded_text(keys, c).alias(f"c{i}") for i, c in enumerate(spec.columns)]
    typed = []
    for i, column in enumerate(spec.columns):
        value = F.try_element_at(keys, F.lit(column))
        known = value.isNull() | is_text(value) if spec.allowed(column) else F.lit(True)
        typed.append(known.alias(f"c{i}"))
    return F.struct(F.struct(*texts).alias("values"), F.struct(*typed).alias("typed"))


def settle(raw: Column, spec: PromptSpec, rules: tuple[Rule, ...] = STANDARD_RULES) -> Column:
    """struct(values, ok) of one raw row answer.

    Order: defaults of rows that do not apply, the N gate, conditional repair, then the type check. The check looks at
    columns with a non-empty rule only, and neither at rows that do not apply nor at gated ones; a repaired cell is text.
    """
    first = raw["values"]["c0"]
    before = {c: raw["values"][f"c{i}"] for i, c in enumerate(spec.columns)}
    gate = gate_rule(spec.columns)
    exempt = F.coalesce(first.isin(NOT_APPLICABLE, gate.value), F.lit(False))
    after = apply_rules(before, (gate, *rules))
    typed = F.lit(True)
    for i, column in enumerate(spec.columns):
        if spec.allowed(column):
            typed = typed & (raw["typed"][f"c{i}"] | ~before[column].eqNullSafe(after[column]))
    values = apply_defaults(after, spec)
    return F.struct(F.struct(*[v.alias(c) for c, v in values.items()]).alias("values"), (exempt | typed).alias("ok"))
