"""Shaping of token-id arrays: truncation, padding, masks, labels, alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.fixed_values import IGNORED_LABEL
from rolltally.functions.text import let


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def repeat(value: int, times: Column) -> Column:
    """Int array of ``times`` copies of ``value``; empty for a negative count."""
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(times, F.lit(0)))


def pad_right(ids: Column, length: Column, pad_id: int) -> Column:
    """Fill up to ``length`` with ``pad_id``; longer arrays stay as they are."""
    return F.concat(ids, repeat(pad_id, length - F.size(ids)))


def length_mask(size: Column, length: Column) -> Column:
    """1 for the first ``size`` positions, 0 for the padding up to ``length``."""
    return F.concat(repeat(1, size), repeat(0, length - size))


def fit(ids: Column, length: int, pad_id: int) -> Column:
    """Cut or fill to exactly ``length`` ids."""
    return F.slice(pad_right(ids, F.lit(length), pad_id), 1, length)


def not_pad_mask(ids: Column, pad_id: int) -> Column:
    """1 where the id is not the pad id, else 0."""
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def prompt_budget(max_length: int | None, max_completion: int) -> int | None:
    """Longest prompt that leaves room for the completion; None without a limit."""
    return max(1, max_length - max_completion) if max_length else None


def completion_part(ids: Column, prompt_length: Column) -> Column:
    """Ids behind the (batch-wide) prompt length."""
    return F.slice(ids, prompt_length + 1, F.size(ids))


def completion_labels(ids: Column, prompt_length: Column, pad_id: int) -> Column:
    """Ids as labels, ignored on the example's own prompt and on every pad id."""
    return let(
        prompt_length,
        lambda own: F.transform(
            ids,
            lambda x, i: F.when((i < own) | (x == pad_id), F.lit(IGNORED_LABEL)).otherwise(x),
        ),
    )


def pad_labels(ids: Column, pad_id: int) -> Column:
    """Ids as labels, ignored on pad ids only."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORED_LABEL)).otherwise(x))


def scoring_positions(per_position: Column, prompt_length: Column) -> Column:
    """Outputs that score the completion: position p-1 scores the token at p."""
    return F.slice(per_position, prompt_length, F.size(per_position) - prompt_length)
