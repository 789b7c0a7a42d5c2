"""Multiple-choice and instruction-following benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions.answers import choice_letter, gold_letter, valid_letters
from rolltally.functions.text import count_when


def _optional(df: DataFrame, *names: str) -> Column:
    """First of the named columns that exists, else null."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("string")


def score_choices(df: DataFrame) -> DataFrame:
    """Score examples that carry their ``response``; keeps what reports group by."""
    valid = valid_letters(F.col("options")) if "options" in df.columns else valid_letters()
    scored = df.withColumns(
        {
            "gold_answer": gold_letter(F.col("answer")),
            "predicted_answer": choice_letter(F.col("response"), valid),
        }
    )
    right = F.coalesce(F.col("predicted_answer") == F.col("gold_answer"), F.lit(False))
    return scored.select(
        "row_index",
        _optional(df, "question_id").alias("question_id"),
        _optional(df, "category").alias("category"),
        _optional(df, "source", "src").alias("source"),
        "gold_answer",
        "predicted_answer",
        right.alias("is_correct"),
        "response",
        "prompt",
        "missing",
    )


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0.0 for nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def choice_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and extraction rate over all examples; missing count only if any."""
    rows = F.count(F.lit(1))
    missing = count_when(F.col("missing"))
    return scored.groupBy(*by).agg(
        ratio(count_when(F.col("is_correct")), rows).alias("mc_accuracy"),
        ratio(count_when(F.col("predicted_answer").isNotNull()), rows).alias("mc_extraction_rate"),
        rows.alias("mc_num_prompts"),
        F.nullif(missing, F.lit(0)).alias("mc_missing_prompts"),
    )


def choice_report(scored: DataFrame) -> DataFrame:
    """Choice metrics per source and category, with subtotals (null = all)."""
    rows = F.count(F.lit(1))
    return scored.rollup("source", "category").agg(
        ratio(count_when(F.col("is_correct")), rows).alias("mc_accuracy"),
        rows.alias("mc_num_prompts"),
        F.grouping_id().cast("int").alias("level"),
    )


def instruction_metrics(
    scored: DataFrame, followed: str = "follow_list", by: Sequence[str] = ()
) -> DataFrame:
    """Prompt-level and instruction-level accuracy from ``array<boolean>`` per prompt.

    An empty list counts as all followed. Both levels are 0.0 without rows.
    """
    held = F.size(F.filter(followed, lambda x: x))
    asked = F.size(followed)
    return scored.groupBy(*by).agg(
        ratio(count_when(held == asked), F.count(F.lit(1))).alias("prompt_level"),
        ratio(F.sum(held), F.sum(asked)).alias("instruction_level"),
        F.count(F.lit(1)).alias("num_prompts"),
        F.coalesce(F.sum(asked), F.lit(0)).cast("long").alias("num_instructions"),
    )


def strict_and_loose_metrics(
    scored: DataFrame,
    strict: str = "strict_list",
    loose: str = "loose_list",
    by: Sequence[str] = (),
) -> DataFrame:
    """Both scorings in one pass, and the number of unanswered prompts if any.

    A prompt text that several rows share counts once among the unanswered ones.
    """

    def levels(name: str, label: str) -> list[Column]:
        held, asked = F.size(F.filter(name, lambda x: x)), F.size(F.col(name))
        return [
            ratio(count_when(held == asked), F.count(F.lit(1))).alias(f"{label}_prompt_level"),
            ratio(F.sum(held), F.sum(asked)).alias(f"{label}_instruction_level"),
        ]

    return scored.groupBy(*by).agg(
        *levels(strict, "strict"),
        *levels(loose, "loose"),
        F.count(F.lit(1)).alias("num_prompts"),
        F.coalesce(F.sum(F.size(strict)), F.lit(0)).cast("long").alias("num_instructions"),
        F.nullif(F.count_distinct(F.when(F.col("missing"), F.xxhash64("prompt"))), F.lit(0)).alias("missing_prompts"),
    )


def metric_rows(metrics: DataFrame, prefix: str) -> DataFrame:
    """Wide one-row metrics as (name, value) rows with prefixed names; nulls are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(f"{prefix}_{c}").alias("name"), F.col(c).cast("double").alias("value"))
            for c in metrics.columns
        ]
    )
    return metrics.select(F.inline(pairs)).where(F.col("value").isNotNull())


def custom_metrics(df: DataFrame, metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """A user's own metrics, given as aggregate expressions, so that they are computed in
    parts like the built-in ones."""
    return df.groupBy(*by).agg(*[value.alias(name) for name, value in metrics.items()])


def apply_scorer(df: DataFrame, scorer, *inputs: str, name: str = "follow_list") -> DataFrame:
    """Score rows with a user's vectorised function, e.g. a rule checker.

    ``scorer`` is a ``pandas_udf`` from the input columns to ``array<boolean>`` (or to
    ``double`` for rewards).
    """
    return df.withColumn(name, scorer(*[F.col(c) for c in inputs]))


def apply_batches(df: DataFrame, function, schema) -> DataFrame:
    """Run a user's function over batches of rows (an iterator of pandas frames)."""
    return df.mapInPandas(function, schema)
