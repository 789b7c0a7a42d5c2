import pytest
from pyspark.sql import functions as F

from rolltally.operators import rollouts, sampling


def test_save_steps(spark):
    df = spark.createDataFrame([("a", s) for s in range(0, 13)] + [("b", 3)], "run string, step long")
    got = {(r["run"], r["step"]): r["save_step"] for r in rollouts.due_batches(df).collect()}
    # Step 0 goes out at 5; 11 and 12 still wait; run b has not come to 5 yet.
    assert got == {("a", s): 5 if s <= 5 else 10 for s in range(0, 11)}


def test_documents_are_bounded_and_ordered(spark):
    df = spark.range(25).select(
        F.lit(5).cast("long").alias("save_step"), F.col("id").alias("position"), (F.col("id") * 2).alias("x")
    ).repartition(5)
    documents = rollouts.nest_rollouts(df, part_rows=10).orderBy("part").collect()
    assert [d["num_samples"] for d in documents] == [25, 25, 25]
    assert [len(d["generations"]) for d in documents] == [10, 10, 5]
    assert [g["x"] for d in documents for g in d["generations"]] == list(range(0, 50, 2))


def test_scores_are_optional(spark):
    left = spark.createDataFrame([(1, 0), (1, 1)], "step long, idx int")
    scores = spark.createDataFrame([(1, 0, 0.5)], "step long, idx int, score double")
    got = rollouts.attach_scores(left, scores).orderBy("idx").collect()
    assert [r["score"] for r in got] == [0.5, None]


def test_flatten(spark):
    df = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, [])], "r int, g array<struct<k: int, v: string>>")
    got = rollouts.flatten_gathered(df, "g", ["r"]).collect()
    assert [(r["r"], r["k"], r["v"]) for r in got] == [(1, 1, "a"), (1, 2, "b")]


def test_metric_windows_and_prefix(spark):
    rows = [("r", "train", "x", s, float(s)) for s in range(1, 7)] + [("r", "eval", "x", 3, 9.0)]
    df = spark.createDataFrame(rows, "run string, mode string, key string, step long, value double")
    got = {(r["key"], r["window_id"]): r["mean_value"] for r in rollouts.metric_means(df, 3).collect()}
    assert got == {("x", 0): 2.0, ("x", 1): 5.0, ("eval_x", 0): 9.0}


def test_policy_losses(spark):
    rows = [("r", 1, 0.5, True), ("r", 1, 0.25, True), ("r", 2, 0.2, True), ("r", 3, 0.1, False)]
    df = spark.createDataFrame(rows, "run string, step long, loss double, on_policy boolean")
    got = rollouts.policy_losses(df, every=2, grad_accumulation=2).orderBy("window_id").collect()
    assert (got[0]["on_policy_loss"], got[0]["off_policy_loss"]) == (0.6333, None)
    assert (got[1]["on_policy_loss"], got[1]["off_policy_loss"]) == (None, 0.2)


def test_last_rows(spark):
    df = spark.createDataFrame([("a", s, i) for s in range(4) for i in range(3)] + [("b", 0, 0)], "run string, step int, idx int")
    kept = {(r["run"], r["step"], r["idx"]) for r in rollouts.last_rows(df, 4).collect()}
    assert kept == {("a", 3, 0), ("a", 3, 1), ("a", 3, 2), ("a", 2, 2), ("b", 0, 0)}
    plan = rollouts.last_rows(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert rollouts.log_buffer_rows(4, 2, 8) == 64


def test_due_steps_and_syncs(spark):
    df = spark.createDataFrame([("r", s) for s in [0, 2, 5, 5, 10]], "run string, step long")
    flags = df.select(rollouts.due(F.col("step"), 5, skip_zero=True), rollouts.due(F.col("step"), 5)).collect()
    assert [tuple(f) for f in flags] == [(False, True), (False, False), (True, True), (True, True), (True, True)]
    synced = spark.createDataFrame([("r", 0)], "run string, step long")
    assert {r["step"] for r in rollouts.due_syncs(df, 5, synced=synced).collect()} == {5, 10}
    assert rollouts.due_syncs(df, 5).count() == 3


def test_statistics_without_divisor(spark):
    empty = spark.createDataFrame([], "n int")
    got = rollouts.generation_stats(empty, F.col("n"), F.lit(0.0)).first()
    assert tuple(got) == (0, 0, 0.0, 0.0)
    some = spark.createDataFrame([(3,), (5,)], "n int")
    assert tuple(rollouts.generation_stats(some, F.col("n"), F.lit(2.0)).first()) == (8, 2, 4.0, 4.0)
    assert rollouts.generation_stats(some, F.col("n"), F.lit(0.0)).first()["tokens_per_second"] == 0.0
    speed = rollouts.speed_metrics(some, F.lit(3.0), batch_size=1, workers=0).first()
    assert tuple(speed) == (2, 2, 3.0, 0.667, 0.667)


def test_checkpoints(spark):
    names = ["checkpoint-100", "checkpoint-25", "checkpoint-9"]
    df = spark.createDataFrame([("r", n) for n in names], "run string, checkpoint string")
    assert [r["step"] for r in rollouts.order_checkpoints(df).collect()] == [9, 25, 100]
    assert rollouts.latest_checkpoint(df).first()["checkpoint"] == "checkpoint-100"
    scores = spark.createDataFrame(
        [("m", "checkpoint-100", 3.0), ("m", None, 1.0), ("m", "checkpoint-9", 2.0)],
        "model string, checkpoint string, v double",
    )
    swept = sampling.checkpoint_sweep(scores, F.avg("v")).collect()
    assert [r["score"] for r in swept] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("fraction", [0.0, 0.01, 0.007, 0.5, 1.0])
def test_split_is_exact(spark, fraction, digits):
    import hashlib
    import math

    ids = [i * 7 for i in range(700)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = {r["id"]: r["split"] for r in sampling.seeded_split(df, fraction, "id", digits=digits).collect()}
    order = sorted(ids, key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    test = set(order[: math.ceil(len(ids) * fraction)])
    assert got == {i: "test" if i in test else "train" for i in ids}


def test_sample_of_unique_prompts(spark):
    df = spark.createDataFrame([(i, f"p{i % 5}") for i in range(50)], "id long, prompt string")
    got = sampling.sample_unique_prompts(df, 3, "id").collect()
    assert len(got) == 3 and all(r["id"] < 5 for r in got)
    assert sampling.sample_unique_prompts(df, 30, "id").count() == 5


def test_first_rows_and_union(spark):
    a = spark.createDataFrame([(3,), (1,)], "i int")
    b = spark.createDataFrame([(2, "x")], "i int, s string")
    assert [r["i"] for r in sampling.first_rows(a, 5, "i").collect()] == [1, 3]
    united = {(r["dataset"], r["i"], r["s"]) for r in sampling.union_named({"a": a, "b": b}).collect()}
    assert united == {("a", 3, None), ("a", 1, None), ("b", 2, "x")}
