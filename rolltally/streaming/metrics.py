"""Streaming aggregates whose updates land in a table.

State is one row per step or log window. Updates are written per micro-batch into a
folder named after the batch, which a replayed batch overwrites, so a restart from the
checkpoint leaves every result exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolltally.operators.rollouts import log_window


def read_rollout_stream(
    spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool = True
) -> DataFrame:
    """Stream of rollout records from a folder that per-step documents are added to.

    A file holds one document, however it is broken into lines, or a document per line.
    """
    documents = spark.readStream.schema(schema).option("multiLine", one_per_file).json(path)
    return documents.select("step", F.explode("generations").alias("record")).select(
        F.col("step").alias("document_step"), "record.*"
    )


def rollout_metrics(
    rollouts: DataFrame,
    key: Sequence[str] = ("step", "idx"),
    arrival: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """Mean scores per step. With an ``arrival`` time column, records that are delivered
    again within ``delay`` count once."""
    if arrival is not None:
        rollouts = rollouts.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(key))
    return rollouts.groupBy("step").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("teacher_reward").alias("teacher_reward"),
        F.avg("student_score").alias("student_score"),
        F.avg("reward_advantage").alias("reward_advantage"),
    )


def window_means(
    metrics: DataFrame, every: int, by: Sequence[str] = ("run", "key")
) -> DataFrame:
    """Mean of each metric per log window of ``every`` steps."""
    return metrics.groupBy(*by, log_window(F.col("step"), every).alias("window_id")).agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("num_values")
    )


def timed_means(
    metrics: DataFrame, time: str, length: str, delay: str, by: Sequence[str] = ("key",)
) -> DataFrame:
    """Mean of each metric per tumbling time window; state is dropped ``delay`` after it."""
    return (
        metrics.withWatermark(time, delay)
        .groupBy(F.window(time, length).alias("at"), *by)
        .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("num_values"))
        .select(F.col("at.start").alias("window_start"), *by, "mean_value", "num_values")
    )


def write_updates(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start writing the updates of an aggregate; ``available_now`` stops at the end of
    what is there."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(store).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_updates(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The last update of every key."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*key, "batch")]
    return (
        updates.groupBy(*key)
        .agg(F.max_by(F.struct(*values), F.col("batch")).alias("_last"))
        .select(*key, "_last.*")
    )


def run_to_table(stream: DataFrame, spark: SparkSession, base: str, key: Sequence[str]) -> DataFrame:
    """Process what is available and return the resulting table."""
    write_updates(stream, f"{base}/updates", f"{base}/state").awaitTermination()
    return latest_updates(spark, f"{base}/updates", key)
