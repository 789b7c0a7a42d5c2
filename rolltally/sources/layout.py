"""Names of output folders, as columns, so that they can partition a result table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.sources.datasets import tagged_name


def eval_tag(
    dataset: Column,
    model: Column,
    checkpoint: Column,
    enable_thinking: Column,
    temperature: Column,
    val_n: Column,
) -> Column:
    """``eval_results_<dataset>_<model>[_<run>_<checkpoint>]_<mode>_temp<t>_valn<n>``.

    The checkpoint is a path of which the last two components count; null leaves it out.
    """
    trimmed = F.rtrim(checkpoint, F.lit("/"))
    run = tagged_name(F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(tagged_name(trimmed))))
    return F.concat_ws(
        "_",
        F.lit("eval_results"),
        dataset,
        tagged_name(model),
        run,
        tagged_name(trimmed),
        F.when(enable_thinking, F.lit("thinking")).otherwise(F.lit("nonthinking")),
        F.concat(F.lit("temp"), temperature.cast("string")),
        F.concat(F.lit("valn"), val_n.cast("string")),
    )


def instruction_tag(split: Column, model_or_checkpoint: Column, gpus: Column, at: Column) -> Column:
    """``ifeval_<split>_<checkpoint>_gpu<gpus>_<UTC time>``."""
    listed = F.replace(gpus, F.lit(","), F.lit(""))
    gpu = F.when(F.coalesce(listed, F.lit("")) != "", listed).otherwise(F.lit("auto"))
    return F.concat(
        F.lit("ifeval_"),
        split,
        F.lit("_"),
        tagged_name(model_or_checkpoint),
        F.lit("_gpu"),
        gpu,
        F.lit("_"),
        F.date_format(at, "yyyy-MM-dd_HHmmss"),
    )


def step_tag(prefix: Column, step: Column) -> Column:
    """``<prefix>_step_<step, six digits>``; longer numbers stay whole."""
    digits = step.cast("string")
    return F.concat(
        prefix, F.lit("_step_"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    )


def model_label(model: Column, checkpoint: Column) -> Column:
    """``<model>+<checkpoint>``, or the model alone where no checkpoint is given."""
    return F.concat_ws("+", tagged_name(model), tagged_name(checkpoint))


def utc_stamp(at: Column) -> Column:
    """Time of a summary, ``2026-03-18T09:05:07Z``."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
