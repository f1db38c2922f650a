"""Conditional repair of coded values and the permissive label check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import MISSING_KEY

# Labels that stand for "nothing", and the value that closes the gate.
MARKERS = ("-", "NONE", "Unknown", "")
NO_NAME = ("NONE", "-", "")
GATE_VALUE = "N"


@dataclass(frozen=True)
class Rule:
    """If ``when`` equals ``value``, set the ``targets`` to ``to``.

    ``needs`` must all be coded columns, otherwise the rule does not apply; targets that are not coded are left out.
    ``unless`` keeps listed target values; ``only`` limits the change to listed ones. A ``final`` rule ends the row.
    """

    when: str
    value: str
    targets: tuple[str, ...]
    to: str
    unless: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    final: bool = False


def gate_rule(columns: Sequence[str]) -> Rule:
    """``N`` in the first column blanks all others, except missing keys."""
    return Rule(when=columns[0], value=GATE_VALUE, targets=tuple(columns[1:]), to="-",
                unless=("-", MISSING_KEY), final=True)


def comparative_rules(flag: str, name: str, position: str) -> tuple[Rule, ...]:
    """Flag ``Y`` needs a name; flag ``N`` clears name and position."""
    both = (flag, name)
    return (
        Rule(when=flag, value="Y", targets=(name,), to="Other", only=NO_NAME, needs=both),
        Rule(when=flag, value="N", targets=(name,), to="NONE", needs=both),
        Rule(when=flag, value="N", targets=(position,), to="-", needs=both),
    )


def abandonment_rules(flag: str, reason: str) -> tuple[Rule, ...]:
    """Flag ``N`` clears the reason."""
    return (Rule(when=flag, value="N", targets=(reason,), to="NONE", needs=(flag, reason)),)


# Column names the standard repairs look for.
STANDARD_RULES = (
    comparative_rules("Comparative_Mention", "Competitor_Named", "Competitive_Position")
    + abandonment_rules("Abandonment_Mentioned", "Abandonment_Reason")
)


def apply_rules(values: Mapping[str, Column], rules: Sequence[Rule]) -> dict[str, Column]:
    """All rules folded into one expression per column, in order; later rules see earlier changes."""
    now = dict(values)
    ended = F.lit(False)
    for rule in rules:
        if rule.when not in now or not all(c in now for c in rule.needs):
            continue
        hit = F.coalesce(now[rule.when] == rule.value, F.lit(False)) & ~ended
        changes = {}
        for target in rule.targets:
            if target not in now:
                continue
            old = now[target]
            change = hit
            if rule.unless:
                change = change & ~F.coalesce(old.isin(*rule.unless), F.lit(False))
            if rule.only:
                change = change & F.coalesce(old.isin(*rule.only), F.lit(False))
            changes[target] = F.when(change, F.lit(rule.to)).otherwise(old)
        if rule.final:
            ended = ended | hit
        now.update(changes)
    return now


def label_class(value: Column, allowed: Column | Sequence[str]) -> Column:
    """Class of a label under a rule; the label itself is never changed.

    A column without a rule (an empty or missing list) is ``unchecked``.
    """
    if isinstance(allowed, Column):
        ruled = F.coalesce(F.size(allowed), F.lit(0)) > 0
        listed = F.array_contains(allowed, value)
    else:
        ruled = F.lit(bool(allowed))
        listed = value.isin(*allowed) if allowed else F.lit(False)
    return (
        F.when(~ruled, "unchecked")
        .when(value.isNull(), "untyped")
        .when(listed, "valid")
        .when(F.startswith(value, F.lit("ERROR_")), "error")
        .when(F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]")), "bracketed")
        .when(value.isin(*MARKERS), "marker")
        .when(F.contains(value, F.lit("_")) | value.rlike(r"^\p{IsUppercase}"), "organic")
        .otherwise("unexpected")
    )
