import json

import pytest
from pyspark.sql import functions as F

from rolltally.streaming import metrics as streams

SCHEMA = "step long, generations array<struct<step: long, idx: int, teacher_reward: double, student_score: double, reward_advantage: double>>"


def put(folder, step, count, reward=1.0):
    records = [
        {"step": step, "idx": i, "teacher_reward": reward, "student_score": 0.5, "reward_advantage": reward - 0.5}
        for i in range(count)
    ]
    document = {"step": step, "num_samples": count, "generations": records}
    (folder / f"generations_step_{step}_{count}_{reward}.json").write_text(json.dumps(document, indent=2))


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", str(tmp_path / "updates"), str(tmp_path / "state")


def run(spark, folders, make):
    source, updates, state = folders
    stream = make(streams.read_rollout_stream(spark, str(source), schema(spark)))
    streams.write_updates(stream, updates, state).awaitTermination()
    return streams.latest_updates(spark, updates, ["step"])


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_new_files_update_results_across_restarts(spark, folders):
    put(folders[0], 5, 2)
    got = run(spark, folders, streams.rollout_metrics).collect()
    assert [(r["step"], r["num_samples"], r["teacher_reward"]) for r in got] == [(5, 2, 1.0)]
    put(folders[0], 5, 1, reward=4.0)
    put(folders[0], 10, 3)
    got = {r["step"]: r for r in run(spark, folders, streams.rollout_metrics).collect()}
    assert (got[5]["num_samples"], got[5]["teacher_reward"]) == (3, 2.0)
    assert (got[10]["num_samples"], got[10]["reward_advantage"]) == (3, 0.5)
    # Nothing new: a third run changes nothing.
    again = {r["step"]: r for r in run(spark, folders, streams.rollout_metrics).collect()}
    assert again == got


def test_stream_equals_batch(spark, folders):
    for step, count in [(5, 4), (10, 7), (15, 1)]:
        put(folders[0], step, count, reward=float(count))
    got = run(spark, folders, streams.rollout_metrics)
    records = spark.read.schema(schema(spark)).option("multiLine", True).json(str(folders[0])).select(
        F.inline("generations")
    )
    expected = streams.rollout_metrics(records)
    assert sorted(map(tuple, got.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_time_windows(spark, tmp_path):
    rows = [("x", 1.0, "2024-01-01 00:10:00"), ("x", 3.0, "2024-01-01 00:50:00"), ("x", 5.0, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "key string, value double, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    means = streams.timed_means(stream, "at", "1 hour", "10 minutes")
    got = streams.run_to_table(means, spark, str(tmp_path), ["window_start", "key"]).orderBy("window_start").collect()
    assert [(r["mean_value"], r["num_values"]) for r in got] == [(2.0, 2), (5.0, 1)]
