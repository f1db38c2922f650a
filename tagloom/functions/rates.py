"""Token counts, rates and progress figures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: elapsed seconds never count as less than this.
LEAST_ELAPSED = 1e-9


def first_count(*candidates: Column) -> Column:
    """The first count that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in candidates], F.lit(0))


def prompt_tokens(eval_count: Column, tokens: Column) -> Column:
    return first_count(eval_count, tokens)


def response_nanos(total: Column, prompt_eval: Column, evaluation: Column) -> Column:
    """Total duration if given, even when zero, else prompt plus evaluation time."""
    parts = F.coalesce(prompt_eval, F.lit(0)) + F.coalesce(evaluation, F.lit(0))
    return F.coalesce(total, parts)


def rows_per_sec(rows: Column, elapsed_sec: Column) -> Column:
    return rows / F.greatest(elapsed_sec, F.lit(LEAST_ELAPSED))


def tokens_per_sec(tokens: Column, nanos: Column) -> Column:
    """NULL without any model time."""
    return F.when(nanos > 0, tokens / (nanos / F.lit(1e9)))


def tokens_per_row(tokens: Column, rows: Column) -> Column:
    return F.when(rows > 0, tokens / rows)


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(F.lit(0.0))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Remaining seconds at the pace so far; NULL before the first row."""
    return F.when(done > 0, elapsed / done * (total - done))
