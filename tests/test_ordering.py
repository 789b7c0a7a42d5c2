import numpy as np
import pytest
from pyspark.sql import functions as F

from rolltally.operators.ordering import _in_ranges, moving_average, row_index, running_totals


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    keys = rng.choice(100_000, size=600, replace=False)
    return [(None if k % 9 == 0 else f"g{k % 3 % 2}", int(k), float(rng.normal())) for k in keys]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, k long, v double").repartition(4)


def grouped(rows):
    groups = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((k, v))
    return groups


@pytest.mark.parametrize("blocks", [1, 7, 64, None])
def test_row_index_with_skewed_and_null_groups(table, rows, blocks):
    got = {(r["g"], r["k"]): r["row_index"] for r in row_index(table, "k", ["g"], blocks=blocks).collect()}
    expected = {(g, k): i for g, members in grouped(rows).items() for i, (k, _) in enumerate(members)}
    assert got == expected


def test_row_index_over_everything(table, rows):
    got = {r["k"]: r["row_index"] for r in row_index(table, "k", blocks=5).collect()}
    assert got == {k: i for i, k in enumerate(sorted(r[1] for r in rows))}


def test_sparse_positions_make_no_more_blocks_than_asked_for(spark):
    far = spark.range(500).select((F.col("id") * 1_000_000).alias("k"))
    placed = _in_ranges(far, ["k"], 8)
    sizes = [r["count"] for r in placed.groupBy("_block").count().collect()]
    assert len(sizes) <= 8 and sum(sizes) == 500 and max(sizes) < 250
    assert {r["k"]: r["row_index"] for r in row_index(far, "k", blocks=8).collect()} == {k * 1_000_000: k for k in range(500)}


def test_empty_table_has_no_positions(spark):
    assert row_index(spark.createDataFrame([], "g string, k long"), "k", ["g"]).collect() == []


def test_running_totals(table, rows):
    summed = running_totals(table, "k", {"total": F.col("v"), "seen": F.lit(1).cast("long")}, ["g"], 9)
    got = {(r["g"], r["k"]): (r["total"], r["seen"]) for r in summed.collect()}
    for g, members in grouped(rows).items():
        sums = np.cumsum([v for _, v in members])
        for i, (k, _) in enumerate(members):
            assert got[g, k][0] == pytest.approx(sums[i]) and got[g, k][1] == i + 1


@pytest.mark.parametrize("decay, block_rows", [(0.01, 1000), (0.5, 1000), (0.9, 1000), (0.999, 1000), (0.999, 7), (0.9999999, 20)])
def test_moving_average_across_blocks(table, rows, decay, block_rows):
    averaged = moving_average(table, ["g"], "k", "v", decay, block_rows=block_rows)
    got = {(r["g"], r["k"]): r["ema"] for r in averaged.collect()}
    for g, members in grouped(rows).items():
        average = None
        for k, v in members:
            average = v if average is None else decay * average + (1 - decay) * v
            assert got[g, k] == pytest.approx(average, rel=1e-9, abs=1e-12)


def test_moving_average_needs_a_proper_decay(table):
    with pytest.raises(ValueError, match="decay"):
        moving_average(table, ["g"], "k", "v", 1.0)


def test_moving_average_forgets_nothing(spark):
    rows = [("g", k, 1e12 if k == 0 else 0.0) for k in range(900)]
    got = moving_average(spark.createDataFrame(rows, "g string, k long, v double"), ["g"], "k", "v", 0.5).collect()
    for r in got:
        assert r["ema"] == pytest.approx(1e12 * 0.5 ** r["k"], rel=1e-9, abs=0)
