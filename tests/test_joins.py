import pytest
from pyspark.sql import functions as F

from rolltally.operators import joins


@pytest.fixture(scope="module")
def examples(spark):
    # One prompt holds a third of all rows; one prompt is null.
    rows = [(i, "hot" if i % 3 == 0 else f"p{i}") for i in range(60)] + [(60, None)]
    return spark.createDataFrame(rows, "id long, prompt string").repartition(3)


@pytest.fixture(scope="module")
def responses(spark):
    rows = [("hot", "old", 1), ("hot", "new", 5), ("p1", "one", 2), ("p2", None, 3), ("unasked", "x", 4)]
    return spark.createDataFrame(rows, "prompt string, response string, key long")


@pytest.mark.parametrize("hot_rows, salts", [(2, 5), (1, 2), (10**6, 8)])
def test_last_response_per_prompt(examples, responses, hot_rows, salts):
    joined = joins.attach_responses_by_prompt(
        examples, responses, "key", ["id"], hot_rows=hot_rows, salts=salts
    )
    got = {r["id"]: (r["response"], r["missing"]) for r in joined.collect()}
    assert len(got) == 61 == joined.count()
    assert all(got[i] == ("new", False) for i in range(0, 60, 3))
    assert got[1] == ("one", False)
    assert got[2] == ("", False)
    assert got[4] == ("", True) and got[60] == ("", True)


def test_without_missing_only_answered_stay(examples, responses):
    joined = joins.attach_responses_by_prompt(examples, responses, "key", ["id"], keep_missing=False, hot_rows=2)
    assert {r["id"] for r in joined.collect()} == {*range(0, 60, 3), 1, 2}


def test_hot_key_is_spread(examples, responses):
    lookup = joins.last_per_key(responses, ["prompt"], "key")
    salted = joins.lookup_join(examples, lookup, ["prompt"], ["id"], hot_rows=2, salts=4)
    assert salted.columns == ["id", "prompt", "response", "key"]
    plan = salted._jdf.queryExecution().toString()
    assert "_salt" in plan and "CartesianProduct" not in plan


def test_by_index_marks_missing(spark):
    examples = spark.createDataFrame([(0,), (1,)], "row_index long")
    responses = spark.createDataFrame([(1, "r")], "row_index long, response string")
    got = joins.attach_responses_by_index(examples, responses).orderBy("row_index").collect()
    assert [(r["response"], r["missing"]) for r in got] == [("", True), ("r", False)]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, None), (None, 1, "n")], "k string, at int, v string")
    last = {r["k"]: (r["at"], r["v"]) for r in joins.last_per_key(df, ["k"], "at").collect()}
    first = {r["k"]: (r["at"], r["v"]) for r in joins.first_per_key(df, ["k"], "at").collect()}
    assert last == {"a": (3, "z"), None: (1, "n")}
    assert first == {"a": (1, "x"), None: (1, "n")}
    assert joins.last_per_key(df, ["k"], "at").columns == df.columns


def test_group_values(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, i, i * i) for i in range(9)] + [(2, 9, -1), (None, 10, 5)], "g int, id int, v int")
    got = joins.with_group_values(df, ["g"], {"top": F.max("v")}, ["id"], hot_rows=3, salts=3)
    assert {(r["g"], r["id"], r["top"]) for r in got.collect()} == {
        *((1, i, 64) for i in range(9)),
        (2, 9, -1),
        (None, 10, 5),
    }


def test_group_values_keep_every_row(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, None, 2), (4, None, None)], "id long, g string, v int")
    got = {r["id"]: r["top"] for r in joins.group_values(df, ["g"], {"top": F.max("v")}).collect()}
    assert got == {1: 7, 2: 7, 3: 2, 4: 2}
