"""Split readers against Spark's own readers of whole files."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from rolltally.sources.datasets import read_dataset
from rolltally.sources.splitting import csv_records, json_array_records, read_split_csv

BYTES = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in (BYTES, COST)}
    yield lambda n: (spark.conf.set(BYTES, str(n)), spark.conf.set(COST, "1"))
    for k, v in kept.items():
        spark.conf.set(k, v)


def fields(rng):
    parts = ["word", ",", '"', "\n", "", "a b", '""', "\n\n", "x,y", " ", "é", "}", "{", "'"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("size, seed", [(16, 1), (64, 2), (1 << 27, 3)])
def test_csv_is_read_alike_whatever_the_ranges(spark, tmp_path, small_ranges, size, seed):
    rng = random.Random(seed)
    path = str(tmp_path / "train.csv")
    rows = [[str(i), "a" + fields(rng), "b" + fields(rng)] for i in range(25)]
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["id", "one text", "other"], *rows])
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()
    small_ranges(size)
    found = read_dataset(spark, path)
    assert found.columns == ["id", "one text", "other"]
    assert ordered(found.collect()) == ordered(whole) == ordered(map(tuple, rows))
    if size == 64:
        assert csv_records(spark, path).select("range").distinct().count() > 5


def test_csv_fields_longer_than_many_ranges(spark, tmp_path, small_ranges):
    path = str(tmp_path / "train.csv")
    rows = [["1", "x\n" * 200], ["2", "y"], ["3", '"\n,' * 100], ["4", ""]]
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["id", "text"], *rows])
    small_ranges(50)
    assert ordered(read_dataset(spark, path).select("id", F.coalesce("text", F.lit(""))).collect()) == ordered(map(tuple, rows))


def test_csv_folders_types_ends_and_loose_quotes(spark, tmp_path, small_ranges):
    folder = tmp_path / "train.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_bytes(b'id,text\r\n1,"a\r\nb"\r\n2,plain\r\n')
    (folder / "part-1.csv").write_bytes(b'id,text\n3,5" pipe\n\n4,"no end of line"')
    (folder / "part-2.csv").write_bytes(b"id,text\n")
    small_ranges(9)
    schema = spark.createDataFrame([], "id int, text string").schema
    rows = ordered(read_split_csv(spark, str(folder), schema).collect())
    assert [(i, t.replace("\r\n", "\n")) for i, t in rows] == [(1, "a\nb"), (2, "plain"), (3, '5" pipe'), (4, "no end of line")]


def objects(rng, count):
    def value(depth):
        kind = rng.randint(0, 7)
        if kind < 3 or depth > 3:
            return rng.choice(["", "a}b", '"', "\\", "{[", "]}", "line\nbreak", "é", "x\\\"}", "plain"])
        if kind == 3:
            return rng.randint(0, 9)
        if kind == 4:
            return [{"k": value(depth + 1)} for _ in range(rng.randint(0, 2))]
        return {"k": value(depth + 1), "z": None}

    return [{"id": i, "deep": json.dumps(value(0)), "nested": {"inner": {"text": value(9)}, "list": [1, 2, i]}} for i in range(count)]


@pytest.mark.parametrize("indent, size", [(None, 60), (2, 150), (0, 1 << 27)])
def test_json_arrays_are_read_alike_whatever_the_ranges(spark, tmp_path, small_ranges, indent, size):
    path = str(tmp_path / "train.json")
    rows = objects(random.Random(7), 12)
    with open(path, "w") as out:
        out.write(" \n" + json.dumps(rows, indent=indent) + "\n")
    schema = spark.read.option("multiLine", True).json(path).schema
    small_ranges(size)
    texts = [r[0] for r in json_array_records(spark, path).select("text").collect()]
    key = lambda x: x["id"]
    assert sorted(map(json.loads, texts), key=key) == rows
    found = read_dataset(spark, path, schema=schema)
    assert sorted((r.asDict(recursive=True) for r in found.collect()), key=key) == rows
    if size == 150:
        inferred = read_dataset(spark, path)
        assert inferred.schema == schema and inferred.count() == 12


def test_json_arrays_without_objects_and_of_one(spark, tmp_path, small_ranges):
    small_ranges(6)
    for name, text, n in (("a", "[]", 0), ("b", '[{"x": "}]"}]', 1), ("c", '[ {} ,\n{"x": {"y": [[1], [2]]}} ]', 2)):
        path = str(tmp_path / f"{name}.json")
        with open(path, "w") as out:
            out.write(text)
        assert json_array_records(spark, path).count() == n
