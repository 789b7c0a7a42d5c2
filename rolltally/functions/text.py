"""Text helpers shared by the other column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.fixed_values import WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst inlines a projected column into a lambda that uses it, which would compute
    it again for every array element. A one-element array keeps it a bound variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space (Unicode, line breaks included) from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def without_whitespace(text: Column) -> Column:
    """Remove every white space character."""
    return F.translate(text, WHITESPACE, "")


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def after_last(text: Column, marker: str) -> Column:
    """Text behind the last ``marker``, or the whole text where it does not occur."""
    return F.substring_index(text, marker, -1)


def from_position(text: Column, start: Column) -> Column:
    """Suffix of ``text`` from a 1-based character position."""
    return F.substring(text, start, F.lit(2**31 - 1))


def require_text(column: Column, name: str) -> Column:
    """``column``, failing the job on a null where text is required."""
    message = F.lit(f"No text in '{name}'")
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(message).cast("string"))


def count_when(condition: Column) -> Column:
    """Number of rows for which ``condition`` holds."""
    return F.count(F.when(condition, F.lit(1)))
