"""Result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write JSON lines in UTF-8, with nulls written as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_jsonl_counted(df: DataFrame, path: str, counts: dict, mode: str = "errorifexists") -> dict:
    """Write JSON lines and return aggregates over the written rows, from the same pass."""
    seen = Observation()
    write_jsonl(df.observe(seen, *[value.alias(name) for name, value in counts.items()]), path, mode)
    return seen.get


def write_rollouts(
    df: DataFrame, path: str, step: str = "save_step", run: Sequence[str] = (), steps_a_folder: int = 1
) -> None:
    """Write rollout records flat, one folder per save step. A step that is written again
    replaces its folder only.

    A folder costs many times what its rows do where steps are small. For tables of many
    such steps, a folder can hold the steps of a range (``steps_from`` and up), which then
    are written again together; the step stays a column of the rows.

    Rebalancing brings the rows of small folders together and splits large ones, so that
    neither tiny files nor one huge file per folder come out.
    """
    if steps_a_folder > 1:
        df = df.withColumn("steps_from", F.col(step) - F.pmod(F.col(step), F.lit(steps_a_folder)))
        step = "steps_from"
    (
        df.hint("rebalance", *run, step)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy(*run, step)
        .json(path)
    )


def write_documents(df: DataFrame, path: str) -> None:
    """Write every row as a JSON file of its own, all in one folder."""
    df.write.option("ignoreNullFields", "false").option("maxRecordsPerFile", 1).json(path)


def read_rollout_documents(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Read per-step documents (one JSON object per file, however it is broken into
    lines) and return one row per record."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    documents = reader.option("multiLine", True).json(path)
    step = "step" if "step" in documents.columns else "save_step"
    return documents.select(
        F.col(step).alias("document_step"), "num_samples", F.explode("generations").alias("record")
    ).select("document_step", "num_samples", "record.*")


def summary_row(metrics: DataFrame, config: dict) -> DataFrame:
    """One-row metrics with the run's settings beside them."""
    return metrics.withColumns({name: F.lit(value) for name, value in config.items()})


def write_summary(summary: DataFrame, path: str) -> None:
    """Write a run summary (one row, one file), replacing an earlier one."""
    write_jsonl(summary.coalesce(1), path, "overwrite")


def append_summary(summary: DataFrame, path: str | None) -> None:
    """Append a run summary to a results log; does nothing without a path."""
    if path:
        write_jsonl(summary.coalesce(1), path, "append")
