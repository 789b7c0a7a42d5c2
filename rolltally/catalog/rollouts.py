"""Rollout records, metric logs and run bookkeeping on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.operators import rollouts as ops
from rolltally.session import new_path
from rolltally.sources.sinks import read_rollout_documents, write_documents, write_jsonl, write_rollouts

_DUE = f"""WITH {b.ROLLOUTS},
due AS (
  SELECT r.*, CAST(greatest(ceil(step / 5.0), 1) * 5 AS BIGINT) AS save_step FROM rollouts r
  JOIN (SELECT run, max(step) AS last FROM rollouts GROUP BY run) m USING (run)
  WHERE greatest(ceil(step / 5.0), 1) * 5 <= last
)"""


@query("due_rollouts", _DUE + " SELECT run, step, idx, event_id, save_step FROM due")
def due_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.due_batches(b.rollouts(spark, sf_dir)).drop("prompt", "completion")


@query(
    "rollout_sink",
    _DUE
    + """ SELECT run, save_step, count(*) AS num_samples, CAST(sum(length(completion)) AS BIGINT) AS num_chars,
                 CAST(sum(event_id) AS BIGINT) AS id_sum FROM due GROUP BY run, save_step""",
)
def rollout_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written flat by run and range of save steps, then read back."""
    path = new_path(spark, "rollouts")
    # Steps of a hundred records each: folders of their own would take most of the time.
    write_rollouts(ops.due_batches(b.rollouts(spark, sf_dir)), path, run=["run"], steps_a_folder=5000)
    schema = "step long, idx int, prompt string, completion string, event_id long, save_step long, run string, steps_from long"
    stored = spark.read.schema(schema).json(path)
    return stored.groupBy("run", "save_step").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum(F.length("completion")).alias("num_chars"),
        F.sum("event_id").alias("id_sum"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per run and save step, of twenty records per step."""
    due = ops.due_batches(b.rollouts(spark, sf_dir)).withColumn("of_run", F.col("run"))
    place = (F.col("step") - F.col("save_step") + 5) * 20 + F.col("idx")
    return ops.nest_rollouts(due.withColumn("position", place), by=["run"])


@query(
    "rollout_documents",
    _DUE
    + """ SELECT run, save_step AS document_step, event_id, step, idx, prompt, completion,
                 count(*) OVER (PARTITION BY run, save_step) AS num_samples FROM due""",
)
def rollout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents written as JSON lines, read back and flattened."""
    documents = _documents(spark, sf_dir)
    path = new_path(spark, "documents")
    write_jsonl(documents, path)
    stored = spark.read.schema(documents.schema).json(path)
    return stored.select(
        "run", F.col("save_step").alias("document_step"), "num_samples", F.explode("generations").alias("record")
    ).select(
        "run",
        "document_step",
        "record.event_id",
        "record.step",
        "record.idx",
        "record.prompt",
        "record.completion",
        "num_samples",
    )


@query(
    "read_step_documents",
    _DUE
    + """ SELECT run, save_step AS document_step, step, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
          FROM due GROUP BY run, save_step, step""",
)
def read_step_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, as runs leave them behind, each record read back."""
    path = new_path(spark, "steps")
    documents = _documents(spark, sf_dir)
    # In one folder: making and listing a folder for each file takes longer than the file.
    write_documents(documents.repartition("run", "save_step", "part"), path)
    records = read_rollout_documents(spark, path, documents.schema)
    return records.groupBy(F.col("of_run").alias("run"), "document_step", "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")
    )


@query(
    "metric_means",
    f"""WITH {b.METRIC_LOG}
        SELECT run, mode, CASE WHEN mode = 'eval' THEN 'eval_' || key ELSE key END AS key, (step - 1) // 10 AS window_id,
               round(avg(value), 9) AS mean_value, count(*) AS num_values
        FROM log GROUP BY ALL""",
)
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ops.metric_means(b.metric_log(spark, sf_dir), every=10)
    return means.withColumn("mean_value", F.round("mean_value", 9))


@query(
    "policy_losses",
    f"""WITH {b.METRIC_LOG}
        SELECT run, (step - 1) // 10 AS window_id,
               round(sum(value) FILTER (on_policy) / (count(*) FILTER (on_policy) / 4.0), 4) AS on_policy_loss,
               round(sum(value) FILTER (NOT on_policy) / (count(*) FILTER (NOT on_policy) / 4.0), 4) AS off_policy_loss
        FROM log GROUP BY run, window_id""",
)
def policy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.policy_losses(b.metric_log(spark, sf_dir), every=10, grad_accumulation=4, loss="value")


@query(
    "last_log_rows",
    f"""WITH {b.ROLLOUTS}
        SELECT run, step, idx, prompt, completion, event_id FROM rollouts
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC, idx DESC) <= 24""",
)
def last_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ops.log_buffer_rows(workers=4, batch_size=3, steps_per_generation=2)
    return ops.last_rows(b.rollouts(spark, sf_dir), keep)


@query(
    "due_steps",
    f"""WITH {b.METRIC_LOG}
        SELECT run, step, bool_or(step > 0 AND step % 5 = 0) AS saves, bool_or(step % 10 = 0) AS logs, count(*) AS n
        FROM log GROUP BY run, step""",
)
def due_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("step")
    return b.metric_log(spark, sf_dir).groupBy("run", "step").agg(
        F.bool_or(ops.due(step, 5, skip_zero=True)).alias("saves"),
        F.bool_or(ops.due(step, 10)).alias("logs"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "due_syncs",
    f"""WITH {b.METRIC_LOG}
        SELECT DISTINCT run, step FROM log l
        WHERE step % 3 = 0 AND NOT EXISTS (SELECT 1 FROM log s WHERE s.run = l.run AND s.step = l.step AND s.mode = 'eval'
                                           AND s.step % 2 = 0)""",
)
def due_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even steps that were evaluated are synced already."""
    log = b.metric_log(spark, sf_dir)
    synced = log.where((F.col("mode") == "eval") & (F.pmod("step", F.lit(2)) == 0)).select("run", "step")
    return ops.due_syncs(log, every=3, synced=synced)


@query(
    "generation_stats",
    """SELECT role, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS total_tokens, count(*) AS num_prompts,
              round(avg(len(string_split(text, ' '))), 6) AS avg_length,
              round(sum(len(string_split(text, ' '))) / (count(*) / 8.0), 6) AS tokens_per_second
       FROM conversations GROUP BY role""",
)
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eighth of a second per turn."""
    stats = ops.generation_stats(
        b.table(spark, sf_dir, "conversations"),
        F.size(b.ids("text")),
        F.count(F.lit(1)) / F.lit(8.0),
        ["role"],
    )
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_length", "tokens_per_second")})


@query(
    "speed_metrics",
    """SELECT event_type, count(*) AS num_samples, CAST(ceil(count(*) / 24.0) AS BIGINT) AS num_steps,
              round(sum(value), 4) AS runtime, round(count(*) / sum(value), 3) AS samples_per_second,
              round(ceil(count(*) / 24.0) / sum(value), 3) AS steps_per_second
       FROM events GROUP BY event_type""",
)
def speed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    return ops.speed_metrics(events, F.sum("value"), batch_size=6, workers=4, by=["event_type"])


@query(
    "latest_checkpoint",
    """SELECT 'run' || CAST(user_id % 3 AS VARCHAR) AS run, max_by('checkpoint-' || CAST(event_id AS VARCHAR), event_id)
              AS checkpoint, max(event_id) AS step FROM events GROUP BY 1""",
)
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints = b.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.pmod("user_id", F.lit(3)).cast("string")).alias("run"),
        F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string")).alias("checkpoint"),
    )
    return ops.latest_checkpoint(checkpoints)


@query(
    "ordered_checkpoints",
    """SELECT 'checkpoint-' || CAST(o_orderkey * 25 AS VARCHAR) AS checkpoint, o_orderkey * 25 AS step FROM orders""",
)
def ordered_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat(F.lit("checkpoint-"), (F.col("o_orderkey") * 25).cast("string"))
    return ops.order_checkpoints(b.table(spark, sf_dir, "orders").select(names.alias("checkpoint")))
