import json
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rolltally.plans.conversion import convert_shards
from rolltally.session import CHECKPOINT_CONF, new_path, shared_dir
from rolltally.sources import benchmarks, datasets, layout, sinks

ROWS = [{"problem": "a\nb, \"c\"", "solution": "ä→"}, {"problem": "p", "solution": "s"}]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def lines(rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def read(spark, path, split="train"):
    df = datasets.read_dataset(spark, str(path), split)
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_folder_prefers_jsonl_then_json_then_parquet_then_csv(spark, tmp_path):
    expected = sorted(ROWS, key=str)
    spark.createDataFrame([("csv",)], "problem string").toPandas().to_csv(tmp_path / "train.csv", index=False)
    assert read(spark, tmp_path) == [{"problem": "csv"}]
    spark.createDataFrame(ROWS).toPandas().to_parquet(tmp_path / "train.parquet")
    assert read(spark, tmp_path) == expected
    write(tmp_path / "train.json", json.dumps([{"problem": "json"}]))
    assert read(spark, tmp_path) == [{"problem": "json"}]
    write(tmp_path / "train.jsonl", lines(ROWS))
    assert read(spark, tmp_path) == expected
    with pytest.raises(ValueError, match="no file of split 'test'"):
        datasets.read_dataset(spark, str(tmp_path), "test")


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_and_lines(spark, tmp_path, indent):
    expected = sorted(ROWS, key=str)
    array = write(tmp_path / "a.json", "\n  " + json.dumps(ROWS, indent=indent))
    assert read(spark, array) == expected
    assert read(spark, write(tmp_path / "b.JSON", lines(ROWS))) == expected
    assert read(spark, write(tmp_path / "c.jsonl", "\n" + lines(ROWS))) == expected


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    spark.createDataFrame(ROWS).toPandas().to_csv(tmp_path / "x.csv", index=False)
    assert read(spark, tmp_path / "x.csv") == sorted(ROWS, key=str)


def test_unsupported_ending_and_unknown_name(spark, tmp_path):
    with pytest.raises(ValueError, match="no supported ending"):
        datasets.read_dataset(spark, write(tmp_path / "x.txt", "hello"))
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        datasets.read_dataset(spark, "no_such_dataset")


def test_registered_name_is_filtered_on_split(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    df.createOrReplaceTempView("registered_dataset")
    assert datasets.read_dataset(spark, "registered_dataset", "test").first()["x"] == 2


def test_instruction_eval_lines(spark, tmp_path):
    row = {"key": 7, "prompt": "p", "instruction_id_list": ["a:b"], "kwargs": [{"n": 3, "s": None}]}
    got = datasets.read_instruction_eval(spark, write(tmp_path / "e.jsonl", lines([row]))).first()
    assert got["key"] == 7 and got["kwargs"][0]["n"] == "3" and got["kwargs"][0]["s"] is None


def test_shards_in_name_order(spark, tmp_path):
    for name, values in [("b", [3, 4, 5]), ("a", [0, 1, 2]), ("c", [6])]:
        spark.createDataFrame([(v,) for v in values], "v int").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "notes.txt").write_text("not a shard")
    shards = datasets.read_shards(spark, str(tmp_path))
    indexed = datasets.with_global_index(shards)
    assert {r["v"]: r["row_index"] for r in indexed.collect()} == {v: v for v in range(7)}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="No parquet files"):
        datasets.read_shards(spark, str(tmp_path / "empty"))


def test_conversion_keeps_columns_and_counts(spark, tmp_path):
    rows = [
        (1, [("user", "q"), ("assistant", r"é \boxed{\frac{1}{2}}")]),
        (2, [("assistant", "one\nAnswer: B.")]),
        (3, [("user", "q")]),
        (4, None),
    ]
    schema = "id int, messages array<struct<role: string, content: string>>"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "in"))
    counts = convert_shards(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert counts == {"total_rows": 4, "extracted_rows": 2, "missing_rows": 2}
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    parsed = {r["id"]: r for r in map(json.loads, text.splitlines())}
    assert {i: r["answer"] for i, r in parsed.items()} == {1: r"\frac{1}{2}", 2: "B", 3: None, 4: None}
    assert parsed[4]["messages"] is None and "é" in text
    assert list(parsed[1]) == ["id", "messages", "answer"]


def test_summary_and_log(spark, tmp_path):
    metrics = spark.createDataFrame([(1, 0.5)], "n int, score double")
    row = sinks.summary_row(metrics, {"model": "m", "gpus": None})
    log = str(tmp_path / "log")
    sinks.append_summary(row, None)
    sinks.append_summary(row, log)
    sinks.append_summary(row, log)
    assert spark.read.json(log).count() == 2
    for _ in range(2):
        sinks.write_summary(row, str(tmp_path / "summary"))
    files = list((tmp_path / "summary").glob("part-*"))
    assert len(files) == 1
    assert json.loads(files[0].read_text()) == {"n": 1, "score": 0.5, "model": "m", "gpus": None}


def test_rollout_step_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "rollouts")
    first = spark.createDataFrame([(5, "a"), (10, "b")], "save_step long, completion string")
    sinks.write_rollouts(first, path)
    sinks.write_rollouts(spark.createDataFrame([(10, "c")], first.schema), path)
    got = {(r["save_step"], r["completion"]) for r in spark.read.json(path).collect()}
    assert got == {(5, "a"), (10, "c")}


def test_steps_of_a_range_share_a_folder(spark, tmp_path):
    path = str(tmp_path / "rollouts")
    rows = [(run, step, f"{run}{step}{i}") for run in "ab" for step in range(5, 205, 5) for i in range(3)]
    first = spark.createDataFrame(rows, "run string, save_step long, completion string")
    sinks.write_rollouts(first, path, run=["run"], steps_a_folder=100)
    assert len(list((tmp_path / "rollouts").glob("run=*/steps_from=*"))) == 6
    again = first.where("run = 'b' and save_step >= 200").withColumn("completion", F.lit("new"))
    sinks.write_rollouts(again, path, run=["run"], steps_a_folder=100)
    got = sorted((r["run"], r["save_step"], r["completion"]) for r in spark.read.json(path).collect())
    assert got == sorted((r, s, "new" if r == "b" and s >= 200 else c) for r, s, c in rows)


def test_documents_are_files_of_one_folder(spark, tmp_path):
    record = {"step": 5, "completion": None}
    documents = [{"save_step": step, "num_samples": 1, "generations": [record]} for step in range(5, 55, 5)]
    df = spark.createDataFrame(documents, "save_step long, num_samples long, generations array<struct<step:long,completion:string>>").coalesce(2)
    sinks.write_documents(df, str(tmp_path / "steps"))
    files = list((tmp_path / "steps").glob("*.json"))
    assert sorted(json.loads(f.read_text())["save_step"] for f in files) == [d["save_step"] for d in documents]
    got = sinks.read_rollout_documents(spark, str(tmp_path / "steps"), df.schema)
    assert sorted(map(tuple, got.collect())) == [(d["save_step"], 1, 5, None) for d in documents]


def test_step_documents_are_flattened(spark, tmp_path):
    for step in (5, 10):
        records = [{"step": step - i, "prompt": "p", "completion": "c", "teacher_reward": -0.5} for i in range(3)]
        document = {"step": step, "num_samples": 3, "generations": records}
        write(tmp_path / f"generations_step_{step}.json", json.dumps(document, indent=2))
    got = sinks.read_rollout_documents(spark, str(tmp_path))
    assert {(r["document_step"], r["step"]) for r in got.collect()} == {(s, s - i) for s in (5, 10) for i in range(3)}


def test_benchmarks(spark):
    aime = spark.createDataFrame([("p", 7, 3)], "problem string, answer int, problem_idx long")
    math500 = spark.createDataFrame(
        [("p", r"x \boxed{1}"), ("q", "plain"), ("r", r"\boxed{1} \boxed")], "problem string, solution string"
    )
    united = benchmarks.union_benchmarks({"AIME25": aime, "math500": math500}).collect()
    assert {(r["benchmark"], r["question_id"], r["problem"], r["gt_answer"]) for r in united} == {
        ("aime25", "3", "p", "7"),
        ("math500", None, "p", "1"),
        ("math500", None, "q", "plain"),
        ("math500", None, "r", r"\boxed{1} \boxed"),
    }
    with pytest.raises(ValueError, match="Unknown dataset: gsm"):
        benchmarks.adapt_benchmark(aime, "gsm")


def test_output_names(spark):
    df = spark.createDataFrame(
        [("/m/Base-1B", "/out/run/checkpoint-50"), ("org/Base-1B/", None)], "model string, checkpoint string"
    )
    tag = layout.eval_tag(F.lit("aime24"), F.col("model"), F.col("checkpoint"), F.lit(True), F.lit(1.0), F.lit(12))
    assert [r[0] for r in df.select(tag).collect()] == [
        "eval_results_aime24_Base-1B_run_checkpoint-50_thinking_temp1.0_valn12",
        "eval_results_aime24_Base-1B_thinking_temp1.0_valn12",
    ]
    at = F.lit(datetime(2026, 3, 18, 9, 5, 7))
    named = layout.instruction_tag(F.lit("test"), F.lit("/x/checkpoint-5"), F.lit("0,1"), at)
    steps = [layout.step_tag(F.lit("eval"), F.lit(n)) for n in (7, 1234567)]
    row = df.select(named, *steps).first()
    assert tuple(row) == ("ifeval_test_checkpoint-5_gpu01_2026-03-18_090507", "eval_step_000007", "eval_step_1234567")


def test_shared_folder_comes_from_the_session(tmp_path):
    def session(folder, master="local[4]"):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: {CHECKPOINT_CONF: folder}.get(key, default)),
            sparkContext=SimpleNamespace(applicationId="app-1", master=master),
        )

    assert shared_dir(session(str(tmp_path))) == str(tmp_path)
    assert new_path(session(f"{tmp_path}/"), "x").startswith(f"{tmp_path}/x-")
    assert shared_dir(session(None)) == shared_dir(session(None)) != str(tmp_path)
    with pytest.raises(ValueError, match="all executors share"):
        shared_dir(session(None, "yarn"))
