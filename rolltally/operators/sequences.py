"""Training sequences from token-id arrays, one row per example."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions import arrays
from rolltally.operators.joins import group_values, with_group_values


def assign_batches(
    df: DataFrame, batch_size: int, workers: int = 1, index: str = "row_index"
) -> DataFrame:
    """Add ``worker`` (round robin by position) and ``batch`` (fixed size per worker)."""
    position = F.col(index)
    worker = F.pmod(position, F.lit(workers))
    turn = (position - worker) / workers
    return df.withColumns(
        {"worker": worker.cast("int"), "batch": F.floor(turn / batch_size)}
    )


def spread_over_workers(df: DataFrame, workers: int) -> DataFrame:
    """Physical round robin: as many partitions as workers, evenly filled."""
    return df.repartition(workers)


def shape_prompts(
    df: DataFrame,
    ids: str,
    batch: Sequence[str],
    row_id: Sequence[str],
    max_length: int,
    pad_id: int,
    prefix: str = "prompt",
    hot_rows: int | None = None,
) -> DataFrame:
    """Truncate, then pad to the longest prompt of the batch.

    Adds ``<prefix>_ids``, ``_mask``, ``_length`` (own) and ``_batch_length``. The batch
    maximum is a partial aggregate looked up again, so ids are never grouped by batch.
    Batches of a fixed size need no more; where "batches" have any size, ``hot_rows``
    spreads those with at least so many rows.
    """
    own, longest = f"{prefix}_length", f"{prefix}_batch_length"
    size = F.least(F.size(F.col(ids)), F.lit(max_length))
    sized = df.withColumn(own, size)
    if hot_rows is None:
        with_longest = group_values(sized, batch, {longest: F.max(own)})
    else:
        with_longest = with_group_values(sized, batch, {longest: F.max(own)}, row_id, hot_rows=hot_rows)
    return with_longest.withColumns(
        {
            f"{prefix}_ids": arrays.pad_right(
                arrays.truncate(F.col(ids), max_length), F.col(longest), pad_id
            ),
            f"{prefix}_mask": arrays.length_mask(F.col(own), F.col(longest)),
        }
    )


def join_completion(
    df: DataFrame,
    prompt_ids: str,
    completion_ids: str,
    max_completion: int,
    pad_id: int,
) -> DataFrame:
    """Add the student sequence: prompt, then the completion fitted to a fixed length."""
    fitted = arrays.fit(F.col(completion_ids), max_completion, pad_id)
    ids = F.concat(F.col(prompt_ids), fitted)
    return df.withColumn("student_ids", ids).withColumns(
        {
            "student_mask": arrays.not_pad_mask(F.col("student_ids"), pad_id),
            "student_pad_labels": arrays.pad_labels(F.col("student_ids"), pad_id),
        }
    )


def add_teacher_and_labels(
    df: DataFrame,
    student_ids: str,
    teacher_prompt_ids: str,
    batch_prompt_length: Column,
    own_prompt_length: Column,
    pad_id: int,
) -> DataFrame:
    """Add the teacher sequence (its prompt, the same completion) and the labels."""
    completion = arrays.completion_part(F.col(student_ids), batch_prompt_length)
    return (
        df.withColumn("completion_ids", completion)
        .withColumn("teacher_ids", F.concat(F.col(teacher_prompt_ids), F.col("completion_ids")))
        .withColumns(
            {
                "teacher_mask": arrays.not_pad_mask(F.col("teacher_ids"), pad_id),
                "labels": arrays.completion_labels(F.col(student_ids), own_prompt_length, pad_id),
            }
        )
    )


def reasoned_teacher_context(
    df: DataFrame,
    reasoning_prompt_ids: str,
    reasoning_ids: str,
    transition_ids: Column,
    pad_id: int,
) -> DataFrame:
    """Add the teacher prompt made of reasoning prompt, reasoning and transition."""
    ids = F.concat(F.col(reasoning_prompt_ids), F.col(reasoning_ids), transition_ids)
    return df.withColumn("teacher_prompt_ids", ids).withColumns(
        {
            "teacher_prompt_mask": arrays.not_pad_mask(F.col("teacher_prompt_ids"), pad_id),
            "teacher_prompt_length": F.size("teacher_prompt_ids"),
        }
    )


def align_next_token(
    df: DataFrame, logits: str, ids: str, prompt_length: Column
) -> DataFrame:
    """One row per completion token with the output that scores it.

    The output at position p-1 scores the token at position p. Keeps all other columns
    and adds ``pos`` (0-based in the completion), ``token_id`` and ``logits_at``.
    """
    pairs = F.arrays_zip(
        arrays.scoring_positions(F.col(logits), prompt_length).alias("logits_at"),
        arrays.completion_part(F.col(ids), prompt_length).alias("token_id"),
    )
    others = [c for c in df.columns if c not in (logits, ids)]
    return df.select(*others, F.posexplode(pairs).alias("pos", "pair")).select(
        *others, "pos", "pair.token_id", "pair.logits_at"
    )
