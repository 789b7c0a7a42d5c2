"""Streams over files, run until what is there is processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.operators.rollouts import nest_rollouts
from rolltally.session import new_path
from rolltally.sources.sinks import write_jsonl
from rolltally.streaming import metrics as streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream. The pattern matches a single file as well as a folder."""
    schema = b.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def utc(local: Column) -> Column:
    """Instant of a time without zone that is meant in UTC, whatever the session's zone."""
    return F.to_timestamp(F.concat(local.cast("string"), F.lit("Z")))


@query(
    "streamed_rollout_metrics",
    f"""WITH {b.ROLLOUTS}
        SELECT step, count(*) AS num_samples, round(avg(event_id / 4), 9) AS teacher_reward,
               round(avg(event_id / 8), 9) AS student_score, round(avg(event_id / 8), 9) AS reward_advantage
        FROM rollouts GROUP BY step""",
)
def streamed_rollout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-step documents, written as JSON lines, streamed and rolled up by step."""
    base = new_path(spark, "stream")
    scored = b.rollouts(spark, sf_dir).select(
        "run",
        "step",
        "idx",
        (F.col("event_id") / 4).alias("teacher_reward"),
        (F.col("event_id") / 8).alias("student_score"),
        (F.col("event_id") / 8).alias("reward_advantage"),
        F.col("idx").cast("long").alias("position"),
    )
    documents = nest_rollouts(scored.withColumn("save_step", F.col("step")), by=["run"])
    documents = documents.withColumnRenamed("save_step", "step")
    write_jsonl(documents, f"{base}/documents")
    records = streams.read_rollout_stream(
        spark, f"{base}/documents", documents.schema, one_per_file=False
    )
    result = streams.run_to_table(streams.rollout_metrics(records), spark, base, ["step"])
    return result.withColumns(
        {c: F.round(c, 9) for c in ("teacher_reward", "student_score", "reward_advantage")}
    )


@query(
    "streamed_rollouts_once",
    """SELECT event_id // 60 AS step, count(*) AS num_samples, round(avg(value), 9) AS teacher_reward,
              round(avg(value) / 2, 9) AS student_score, round(avg(value) / 2, 9) AS reward_advantage
       FROM events GROUP BY 1""",
)
def streamed_rollouts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is delivered twice and counts once."""
    twice = event_stream(spark, sf_dir).select(
        b.div("event_id", 60).alias("step"),
        F.col("event_id").alias("idx"),
        F.col("value").alias("teacher_reward"),
        (F.col("value") / 2).alias("student_score"),
        (F.col("value") / 2).alias("reward_advantage"),
        utc(F.col("ts")).alias("arrival"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
    )
    once = streams.rollout_metrics(twice, arrival="arrival", delay="365 days")
    result = streams.run_to_table(once, spark, new_path(spark, "stream"), ["step"])
    return result.withColumns(
        {c: F.round(c, 9) for c in ("teacher_reward", "student_score", "reward_advantage")}
    )


@query(
    "streamed_window_means",
    f"""WITH {b.METRIC_LOG}
        SELECT run, key, (step - 1) // 10 AS window_id, round(avg(value), 9) AS mean_value, count(*) AS num_values
        FROM log GROUP BY ALL""",
)
def streamed_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    log = events.select(
        F.concat(F.lit("run"), F.pmod("user_id", F.lit(3)).cast("string")).alias("run"),
        F.col("event_type").alias("key"),
        (b.div("event_id", 25) + 1).alias("step"),
        "value",
    )
    means = streams.window_means(log, every=10)
    result = streams.run_to_table(means, spark, new_path(spark, "stream"), ["run", "key", "window_id"])
    return result.withColumn("mean_value", F.round("mean_value", 9))


@query(
    "streamed_time_windows",
    """SELECT strftime(time_bucket(INTERVAL 6 hours, ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS key,
              round(avg(value), 9) AS mean_value, count(*) AS num_values
       FROM events GROUP BY ALL""",
)
def streamed_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling six-hour windows with a watermark over the event time."""
    log = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("key"), "value", utc(F.col("ts")).alias("at_time")
    )
    means = streams.timed_means(log, "at_time", "6 hours", "365 days")
    result = streams.run_to_table(means, spark, new_path(spark, "stream"), ["window_start", "key"])
    start = F.convert_timezone(None, F.lit("UTC"), F.col("window_start"))
    return result.select(
        F.date_format(start, "yyyy-MM-dd HH:mm").alias("window_start"),
        "key",
        F.round("mean_value", 9).alias("mean_value"),
        "num_values",
    )
