"""Patterns and column builders for the text run log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairset.schema import null_if_nan

# The line shapes of the run log. Numbers are taken as loose tokens, so a ``nan`` or
# scientific value keeps its line and becomes NULL or a number.
ANSI = r"\x1b\[[0-9;]*m"
STEP = (r"epoch (\d+) \| step (\d+)/\d+ \| loss (\S+) \(avg (\S+?)\) \| lr (\S+) \| (\S+?)s/it")
VALIDATION = r"\[validation\] epoch (\d+) step (\d+) \| val_loss (\S+)"
VRAM = r"vram ([\d.]+)/([\d.]+)GB"
GPU = r"gpu (\d+)% (\d+)C"
GRAD_NORM = r"gnorm (\S+)"


def plain(line: Column | str) -> Column:
    """The line without colour codes; lines that have none are not searched."""
    c = F.col(line) if isinstance(line, str) else line
    return F.when(c.contains("\x1b["), F.regexp_replace(c, ANSI, "")).otherwise(c)


def logged_at(line: Column) -> Column:
    """The time stamp a line starts with, or NULL."""
    stamp = F.regexp_extract(line, r"^(?:\x1b\[[0-9;]*m)?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(stamp)


def run_name(prefix: str, started: Column) -> Column:
    """A run's name from its start time."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(started, "yyyyMMdd_HHmmss"))


def first_match(line: Column, pattern: str) -> Column:
    """The matching part of a line as an array of one element, empty without a match."""
    return F.slice(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), 1, 1)


def groups(match: Column, pattern: str, count: int) -> Column:
    """All groups of a matched part, as an array; NULL for an empty match."""
    order = "\t".join(f"${i}" for i in range(1, count + 1))
    return F.when(match != "", F.split(F.regexp_replace(match, pattern, order), "\t"))


def number(text: Column) -> Column:
    """A number, or NULL for text that is not one and for NaN and infinities."""
    x = null_if_nan(text.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def whole(text: Column) -> Column:
    return text.try_cast("int")
