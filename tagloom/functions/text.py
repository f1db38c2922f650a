"""Prompt text and identifiers as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that text trimming removes (Unicode white space).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


@dataclass(frozen=True)
class Wording:
    """Prompt wording; the fields and their order are what the operators guarantee."""

    single_intro: str = "Please label the message below.\n\n"
    batch_intro: str = "Please label the {n} messages below and answer with one JSON array, one object per message, same order.\n"
    item_head: str = "\n--- message {i} of {n} ---\n"
    row_id: str = "RowID: "
    sentiment: str = "Given sentiment: "
    sentiment_hint: str = " (correct it if it is wrong)"
    title: str = "Title: "
    content: str = "Content: "
    batch_close: str = "\nThe array must hold exactly {n} objects."


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def filled(template: str, **values: Column) -> Column:
    """``template`` with its ``{name}`` fields replaced by columns, all at once."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def title_clause(title: Column, wording: Wording = Wording()) -> Column:
    """One title line, or nothing for a null, blank or ``nan`` title. The title itself is not trimmed."""
    shown = title.isNotNull() & (stripped(title) != "") & (title != "nan")
    return F.when(shown, F.concat(F.lit(wording.title), title, F.lit("\n"))).otherwise(F.lit(""))


def row_body(row_id: Column, sentiment: Column, title: Column, message: Column, wording: Wording = Wording()) -> Column:
    """Id, given sentiment, optional title, content; shared by single and batch prompts."""
    return F.concat(
        F.lit(wording.row_id), row_id.cast("string"), F.lit("\n" + wording.sentiment),
        F.coalesce(sentiment, F.lit("")), F.lit(wording.sentiment_hint + "\n\n"),
        title_clause(title, wording), F.lit(wording.content), F.coalesce(message, F.lit("")), F.lit("\n"),
    )


def single_prompt(row_id: Column, sentiment: Column, title: Column, message: Column,
                  wording: Wording = Wording()) -> Column:
    return F.concat(F.lit(wording.single_intro), row_body(row_id, sentiment, title, message, wording))


def batch_prompt(bodies: Column, wording: Wording = Wording()) -> Column:
    """Prompt for an ordered array of row bodies."""
    n = F.size(bodies)
    items = F.transform(bodies, lambda body, i: F.concat(filled(wording.item_head, i=i + 1, n=n), body))
    return F.concat(filled(wording.batch_intro, n=n), F.array_join(items, ""), filled(wording.batch_close, n=n))


def slug(text: Column) -> Column:
    """Everything but letters, digits, ``-`` and ``_`` becomes ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def short_name(text: Column) -> Column:
    """First ten letters or digits; NULL when there are none."""
    return F.nullif(F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), 1, 10), F.lit(""))


def model_tag(catalog_id: Column, model_name: Column) -> Column:
    """``m`` + catalog id, else a short form of the name, else ``munknown``."""
    known = F.nullif(catalog_id.cast("string"), F.lit(""))
    return F.concat(F.lit("m"), F.coalesce(known, short_name(model_name), F.lit("unknown")))


def run_id(project: Column, version: Column, tag: Column, stamp: Column) -> Column:
    return F.concat_ws("_", slug(project), slug(version), tag, stamp)


def output_name(pattern: str, worker_id: Column | None = None, **fields: Column) -> Column:
    """File name from a pattern over project, version, label, date and run_id, plus ``_w{n}`` for one worker."""
    name = filled(pattern, **fields)
    if worker_id is not None:
        name = F.concat(name, F.lit("_w"), worker_id.cast("string"))
    return F.concat(name, F.lit(".csv"))


def versioned_name(base: Column, run: Column, row_range: Column, extension: str) -> Column:
    """Run-scoped file name; the range is optional."""
    tail = F.coalesce(F.concat(F.lit("_"), F.nullif(row_range, F.lit(""))), F.lit(""))
    return F.concat(F.coalesce(base, F.lit("")), run, tail, F.lit("." + extension.lstrip(".")))


def stamped_name(base: Column, stamp: Column, model_id: Column, batch_size: Column, row_range: Column,
                 extension: str) -> Column:
    """File name of a run without a run id: time stamp, model, batch size and range, ``unknown`` when not given."""
    def known(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("unknown"))

    return F.concat(base, F.lit("_v"), stamp, F.lit("_m"), known(model_id), F.lit("_b"), known(batch_size),
                    F.lit("_r"), known(row_range), F.lit("." + extension.lstrip(".")))


def job_id(start: Column, end: Column, worker_id: Column, run: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit("_w"), worker_id.cast("string"),
                    F.lit("_"), run)


def part_name(job: Column, part: Column) -> Column:
    """Part names keep at least four digits; longer numbers are not cut."""
    digits = part.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("checkpoint_"), job, F.lit("_part"), padded)


def format_duration(seconds: Column) -> Column:
    """Whole seconds as ``HH:MM:SS``, or ``MM:SS`` below one hour."""
    total = seconds.cast("long")
    hours = F.floor(total / 3600).cast("string")
    minutes = F.lpad(F.floor(total % 3600 / 60).cast("string"), 2, "0")
    rest = F.lpad((total % 60).cast("string"), 2, "0")
    wide_hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.when(total >= 3600, F.concat_ws(":", wide_hours, minutes, rest)).otherwise(F.concat_ws(":", minutes, rest))


def metric_key(column: Column, value: Column) -> Column:
    """Name of a count in the wide analytics row."""
    return F.concat(F.replace(F.lower(column), F.lit("_"), F.lit("")), F.lit("_"), F.translate(value, " -", "__"))
