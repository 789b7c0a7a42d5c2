import pytest
from pyspark.sql import functions as F

from rolltally.functions import arrays
from rolltally.operators import sequences


@pytest.fixture(scope="module")
def table(spark):
    rows = [(0, 0, [1, 2, 3, 4, 5], [9, 0, 9]), (1, 0, [6], [8] * 6), (2, 1, [], []), (3, None, [7, 0], [5])]
    return spark.createDataFrame(rows, "id int, batch int, ids array<int>, reply array<int>")


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_prompts_are_padded_to_the_longest_of_the_batch(table, hot_rows):
    known = table.where("batch is not null")
    shaped = sequences.shape_prompts(known, "ids", ["batch"], ["id"], 4, 0, hot_rows=hot_rows)
    got = {r["id"]: r for r in shaped.collect()}
    assert got[0]["prompt_ids"] == [1, 2, 3, 4] and got[0]["prompt_mask"] == [1, 1, 1, 1]
    assert got[1]["prompt_ids"] == [6, 0, 0, 0] and got[1]["prompt_mask"] == [1, 0, 0, 0]
    assert got[2]["prompt_ids"] == [] and got[2]["prompt_batch_length"] == 0
    assert [got[i]["prompt_length"] for i in range(3)] == [4, 1, 0]


def test_mask_follows_length_not_the_pad_id(spark):
    df = spark.createDataFrame([(0, 0, [0, 3])], "id int, batch int, ids array<int>")
    row = sequences.shape_prompts(df, "ids", ["batch"], ["id"], 4, 0).first()
    assert row["prompt_mask"] == [1, 1]


def test_student_teacher_and_labels(table):
    shaped = sequences.shape_prompts(table.where("id < 2"), "ids", ["batch"], ["id"], 4, 0)
    joined = sequences.join_completion(shaped, "prompt_ids", "reply", 4, 0)
    joined = joined.withColumn("teacher_prompt_ids", F.array(F.lit(3), F.lit(0)))
    trained = sequences.add_teacher_and_labels(
        joined, "student_ids", "teacher_prompt_ids", F.col("prompt_batch_length"), F.col("prompt_length"), 0
    )
    first, second = trained.orderBy("id").collect()
    assert first["student_ids"] == [1, 2, 3, 4, 9, 0, 9, 0]
    assert first["student_mask"] == [1, 1, 1, 1, 1, 0, 1, 0]
    assert first["student_pad_labels"] == [1, 2, 3, 4, 9, -100, 9, -100]
    assert first["completion_ids"] == [9, 0, 9, 0]
    assert first["teacher_ids"] == [3, 0, 9, 0, 9, 0]
    assert first["teacher_mask"] == [1, 0, 1, 0, 1, 0]
    assert first["labels"] == [-100, -100, -100, -100, 9, -100, 9, -100]
    # The own prompt is shorter than the batch's: its padding is ignored as pad id.
    assert second["student_ids"] == [6, 0, 0, 0, 8, 8, 8, 8]
    assert second["labels"] == [-100, -100, -100, -100, 8, 8, 8, 8]


def test_reasoned_context(table):
    transition = F.array(F.lit(4), F.lit(0))
    row = sequences.reasoned_teacher_context(table.where("id = 3"), "ids", "reply", transition, 0).first()
    assert row["teacher_prompt_ids"] == [7, 0, 5, 4, 0]
    assert row["teacher_prompt_mask"] == [1, 0, 1, 1, 0]
    assert row["teacher_prompt_length"] == 5


def test_budget():
    assert arrays.prompt_budget(100, 30) == 70
    assert arrays.prompt_budget(20, 30) == 1
    assert arrays.prompt_budget(None, 30) is None


def test_alignment_shifts_by_one(spark):
    df = spark.createDataFrame([(0, [10, 11, 12, 13], [0.0, 0.1, 0.2, 0.3])], "id int, ids array<int>, out array<double>")
    rows = sequences.align_next_token(df, "out", "ids", F.lit(2)).orderBy("pos").collect()
    assert [(r["pos"], r["token_id"], r["logits_at"]) for r in rows] == [(0, 12, 0.1), (1, 13, 0.2)]


def test_workers_take_turns_and_fill_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "row_index")
    got = [
        (r["worker"], r["batch"])
        for r in sequences.assign_batches(df, batch_size=2, workers=3).orderBy("row_index").collect()
    ]
    # What each worker does: every third row from its own number, cut into pairs.
    expected = {}
    for worker in range(3):
        own = list(range(worker, 10, 3))
        for place, row in enumerate(own):
            expected[row] = (worker, place // 2)
    assert got == [expected[i] for i in range(10)]
    assert sequences.spread_over_workers(df, 3).rdd.getNumPartitions() == 3
