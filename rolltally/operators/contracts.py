"""Checks and choices made from column names alone; none of them runs a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rolltally.functions.fixed_values import (
    INSTRUCTION_EVAL_COLUMNS,
    INSTRUCTION_FORMATS,
    MATH_FORMAT,
    MULTIPLE_CHOICE_COLUMNS,
    SIGNATURE_COLUMNS,
)


def require_columns(
    df: DataFrame,
    fmt: str,
    prompt_column: str,
    solution_column: str | None = None,
    teacher_prompt_column: str | None = None,
    teacher_reference_column: str | None = None,
    role: str = "dataset",
) -> DataFrame:
    """Fail unless the columns a dataset format needs are there; returns ``df``.

    Each format has groups of columns of which one must exist.
    """
    prompt = (prompt_column,)
    teacher = tuple(c for c in (teacher_prompt_column, teacher_reference_column) if c)
    groups = {MATH_FORMAT: (prompt, (solution_column,))}.get(fmt, (prompt, teacher))
    return _require(df, groups, fmt, role)


def require_prompt_column(df: DataFrame, fmt: str, prompt_column: str, role: str = "dataset") -> DataFrame:
    """Contract of the shared-prompt case, where only the prompt is read."""
    return _require(df, ((prompt_column,),), fmt, role)


def _require(df: DataFrame, groups: Iterable[tuple[str, ...]], fmt: str, role: str) -> DataFrame:
    absent = [" or ".join(map(str, group)) for group in groups if not set(group) & set(df.columns)]
    if absent:
        raise ValueError(f"The {fmt} {role} lacks {', '.join(sorted(absent))}; it has {', '.join(sorted(df.columns))}.")
    return df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Sorted names that are required but absent."""
    return sorted(set(required) - set(df.columns))


def require_text_type(df: DataFrame, *names: str) -> DataFrame:
    """Fail unless each named column exists and holds strings."""
    for name in names:
        if name not in df.columns:
            raise KeyError(f"No column {name} among {', '.join(df.columns)}")
        if not isinstance(df.schema[name].dataType, T.StringType):
            raise TypeError(f"{name} holds {df.schema[name].dataType.simpleString()} where text is needed")
    return df


def check_format(fmt: str) -> None:
    if fmt != MATH_FORMAT and fmt not in INSTRUCTION_FORMATS:
        raise ValueError(
            f"No such dataset format: {fmt}. There are {', '.join(sorted((MATH_FORMAT, *INSTRUCTION_FORMATS)))}."
        )


def check_teacher_options(
    fmt: str = MATH_FORMAT,
    reason_first: bool = False,
    moving_average_teacher: bool = False,
    fixed_teacher: bool = False,
) -> None:
    """Reject options that exclude each other."""
    check_format(fmt)
    if reason_first and fmt != MATH_FORMAT:
        raise ValueError("Reasoning first works with the math format only.")
    if moving_average_teacher and fixed_teacher:
        raise ValueError("A teacher is either a moving average or fixed, not both.")


def select_signature(df: DataFrame, *parameter_columns: str | None) -> DataFrame:
    """Keep the known training columns and those named by parameters, in that order."""
    wanted = dict.fromkeys([*SIGNATURE_COLUMNS, *[c for c in parameter_columns if c]])
    return df.select(*[c for c in wanted if c in df.columns])


def dataset_kind(df: DataFrame) -> str:
    """``instruction``, ``multiple_choice`` or ``generic``, told by the columns."""
    if not missing_columns(df, INSTRUCTION_EVAL_COLUMNS):
        return "instruction"
    if not missing_columns(df, MULTIPLE_CHOICE_COLUMNS):
        return "multiple_choice"
    return "generic"
