"""Rollout records, metric logs and training-loop bookkeeping as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.functions.fixed_values import SAVE_EVERY
from rolltally.operators.joins import group_values

PART_ROWS = 256


# --- Rollout records ----------------------------------------------------------------


def attach_scores(
    rollouts: DataFrame, scores: DataFrame, on: Sequence[str] = ("step", "idx")
) -> DataFrame:
    """Rollouts with their scores where a score of the same position exists."""
    return rollouts.join(scores, list(on), "left")


def flatten_gathered(df: DataFrame, gathered: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per struct of a gathered list, in place of the list."""
    return df.select(*keep, F.inline(gathered))


def due_batches(
    rollouts: DataFrame, run: Sequence[str] = ("run",), every: int = SAVE_EVERY
) -> DataFrame:
    """Rows that reach disk, with the ``save_step`` that writes them.

    Records gather until the next positive multiple of ``every``. Those behind the last
    one a run has reached are still waiting, and left out.
    """
    due = F.greatest(F.ceil(F.col("step") / every), F.lit(1)) * every
    placed = rollouts.withColumn("save_step", due.cast("long"))
    reached = group_values(placed, run, {"_last": F.max("step")})
    return reached.where(F.col("save_step") <= F.col("_last")).drop("_last")


def nest_rollouts(
    rollouts: DataFrame,
    step: str = "save_step",
    position: str = "position",
    part_rows: int = PART_ROWS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Documents of ``step``, ``num_samples`` and ``generations`` in order.

    ``position`` is the 0-based place of a record within its step. A document holds at
    most ``part_rows`` records; further ones go to the parts that follow. ``num_samples``
    is the number of all records of the step, on each of its parts.
    """
    place = F.col(position)
    part = ((place - F.pmod(place, F.lit(part_rows))) / part_rows).cast("int")
    fields = [c for c in rollouts.columns if c not in (*by, step)]
    ordered = F.struct(place.alias("_at"), F.struct(*fields).alias("record"))
    documents = (
        rollouts.withColumn("part", part)
        .groupBy(*by, step, "part")
        .agg(F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x["record"]).alias("generations"))
    )
    totals = rollouts.groupBy(*by, step).agg(F.count(F.lit(1)).alias("num_samples"))
    return documents.join(totals, [*by, step]).select(*by, step, "part", "num_samples", "generations")


# --- Metric logs --------------------------------------------------------------------


def log_window(step: Column, every: int) -> Column:
    """Window of a 1-based step; each window closes at a multiple of ``every``."""
    return F.floor((step - 1) / every)


def metric_means(
    metrics: DataFrame, every: int, by: Sequence[str] = ("run", "mode", "key")
) -> DataFrame:
    """Mean of each metric per log window; evaluation keys get their prefix."""
    means = metrics.groupBy(*by, log_window(F.col("step"), every).alias("window_id")).agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("num_values")
    )
    if "mode" in by and "key" in by:
        logged = F.when(F.col("mode") == "eval", F.concat(F.lit("eval_"), "key")).otherwise(F.col("key"))
        means = means.withColumn("key", logged)
    return means


def policy_losses(
    steps: DataFrame,
    every: int,
    grad_accumulation: int,
    by: Sequence[str] = ("run",),
    on_policy: str = "on_policy",
    loss: str = "loss",
) -> DataFrame:
    """On- and off-policy loss per log window, over all workers; null for an absent class.

    Each forward pass counts as ``1 / grad_accumulation`` steps.
    """

    def averaged(flag: Column) -> Column:
        total = F.sum(F.when(flag, F.col(loss)))
        passes = F.count(F.when(flag, F.lit(1)))
        return F.round(F.try_divide(total, passes / F.lit(max(1, grad_accumulation))), 4)

    return steps.groupBy(*by, log_window(F.col("step"), every).alias("window_id")).agg(
        averaged(F.col(on_policy)).alias("on_policy_loss"),
        averaged(~F.col(on_policy)).alias("off_policy_loss"),
    )


def last_rows(
    df: DataFrame, keep: int, order_by: Sequence[str] = ("step", "idx"), run: Sequence[str] = ("run",)
) -> DataFrame:
    """The last ``keep`` rows of each run. Ranks are limited before the shuffle, so a long
    run sends at most ``keep`` rows per task."""
    latest = Window.partitionBy(*run).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= keep).drop("_rank")


def log_buffer_rows(workers: int, batch_size: int, steps_per_generation: int) -> int:
    """Size of the buffer that holds the texts of the last optimizer step."""
    return workers * batch_size * steps_per_generation


def due(step: Column, every: int, skip_zero: bool = False) -> Column:
    """Whether something that happens every so many steps happens at ``step``."""
    hit = F.pmod(step, F.lit(every)) == 0
    return hit & (step > 0) if skip_zero else hit


def due_syncs(
    steps: DataFrame, every: int, run: Sequence[str] = ("run",), synced: DataFrame | None = None
) -> DataFrame:
    """Steps at which weights are handed over: due ones, each once, not yet synced."""
    wanted = steps.where(due(F.col("step"), every)).select(*run, "step").distinct()
    return wanted if synced is None else wanted.join(synced, [*run, "step"], "left_anti")


# --- Statistics ---------------------------------------------------------------------


def generation_stats(
    df: DataFrame, num_tokens: Column, seconds: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Tokens, prompts, mean length and tokens per second; 0 where there is no divisor.

    ``num_tokens`` is per row, ``seconds`` an aggregate over the group.
    """
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(num_tokens), F.lit(0)).cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("num_prompts"),
        F.coalesce(F.avg(num_tokens), F.lit(0.0)).alias("avg_length"),
        F.coalesce(
            F.try_divide(F.sum(num_tokens).cast("double"), F.greatest(seconds, F.lit(0.0))),
            F.lit(0.0),
        ).alias("tokens_per_second"),
    )


def speed_metrics(
    df: DataFrame,
    seconds: Column,
    batch_size: int,
    workers: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Run time, samples and steps per second; a step is one batch on every worker."""
    per_step = max(1, batch_size) * max(1, workers)
    rows = F.count(F.lit(1))
    measured = df.groupBy(*by).agg(rows.alias("num_samples"), seconds.alias("_seconds"))
    steps = F.ceil(F.col("num_samples") / per_step)

    def rate(amount: Column) -> Column:
        return F.round(F.try_divide(amount.cast("double"), F.col("_seconds")), 3)

    return measured.select(
        *by,
        "num_samples",
        steps.alias("num_steps"),
        F.round("_seconds", 4).alias("runtime"),
        rate(F.col("num_samples")).alias("samples_per_second"),
        rate(steps).alias("steps_per_second"),
    )


# --- Checkpoints --------------------------------------------------------------------


def checkpoint_number(name: Column) -> Column:
    """Number at the end of a checkpoint name."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("long")


def order_checkpoints(df: DataFrame, name: str = "checkpoint") -> DataFrame:
    """Checkpoints in the order of their number, not of their text."""
    return df.withColumn("step", checkpoint_number(F.col(name))).orderBy("step")


def latest_checkpoint(
    df: DataFrame, run: Sequence[str] = ("run",), name: str = "checkpoint"
) -> DataFrame:
    """The checkpoint of each run with the highest number."""
    number = checkpoint_number(F.col(name))
    return df.groupBy(*run).agg(F.max_by(F.col(name), number).alias(name), F.max(number).alias("step"))
