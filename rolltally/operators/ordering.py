"""Positions, running totals and moving averages that do not need one task per group.

A plain window over a group puts the whole group into one task. Here rows are dealt by rank
to ranges of (group, order column), whatever the values are: a range holds many small groups
or a part of a large one. Totals of the ranges are aggregated first, a group that spans
several is handed what came before, and the window inside a range adds the rest. Ranges come
from sampled bounds, so the rows are written once with their range, which then holds for all
that is derived from it, lost executors included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.session import new_path

BLOCK_ROWS = 100_000


def _in_ranges(df: DataFrame, keys: Sequence[str], blocks: int | None) -> DataFrame:
    """Rows with the number of their range of ``keys`` in ``_block``, written and read back."""
    dealt = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    placed = dealt.withColumn("_block", F.spark_partition_id())
    path = new_path(df.sparkSession, "ranges")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def running_totals(
    df: DataFrame,
    order_by: str,
    totals: dict[str, Column],
    partition_by: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of the given expressions, per group, in order.

    ``blocks`` is the number of ranges, by default that of shuffle partitions, which adaptive
    execution joins where they are small. This writes the rows, so it runs when called.
    """
    group = list(partition_by)
    keyed = df.withColumns({f"_add_{name}": value for name, value in totals.items()})
    keyed = _in_ranges(keyed, [*group, order_by], blocks)

    sums = keyed.groupBy(*group, "_block").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_add_{name}").alias(f"_add_{name}") for name in totals]
    )
    # A group has at most one row per range here, and is handed something only behind its first.
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = sums.select(
        *group,
        "_block",
        F.sum("_rows").over(earlier).alias("_rows"),
        *[F.sum(f"_add_{name}").over(earlier).alias(f"_add_{name}") for name in totals],
    )
    carried = carried.where("_rows IS NOT NULL").drop("_rows")
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(F.col("_carried").desc(), order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _with_carried(keyed, carried)
        .withColumns({name: F.sum(f"_add_{name}").over(inside) for name in totals})
        .where(~F.col("_carried"))
        .select(*df.columns, *totals)
    )


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows plus, per block that is handed something, one marked row with it."""
    return rows.withColumn("_carried", F.lit(False)).unionByName(
        carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True
    )


def row_index(
    df: DataFrame,
    order_by: str,
    partition_by: Sequence[str] = (),
    name: str = "row_index",
    blocks: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the order of a unique column."""
    counted = running_totals(df, order_by, {name: F.lit(1).cast("long")}, partition_by, blocks)
    return counted.withColumn(name, F.col(name) - 1)


def moving_average(
    df: DataFrame,
    series: Sequence[str],
    order_by: str,
    value: str,
    decay: float,
    name: str = "ema",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exponential moving average per series: the first value is the seed, then
    ``decay * average + (1 - decay) * value`` in order.

    The recurrence is linear, so a block of rows hands over one number: its own sum, decayed
    to its end, and what it was handed itself, decayed by the block's length. Blocks are as
    long as powers of ``decay`` stay well inside double precision, and no longer than
    ``block_rows``, so a long series is spread over many tasks at any ``decay``.
    """
    if not 0 < decay < 1:
        raise ValueError(f"decay must lie between 0 and 1, got {decay}")
    length = max(1, min(block_rows, math.ceil(80 / -math.log(decay))))
    keys = list(series)
    placed = row_index(df, order_by, keys, "_at")
    local = F.pmod(F.col("_at"), F.lit(length))
    placed = placed.withColumns(
        {
            "_local": local,
            "_part": F.floor((F.col("_at") - local) / length),
            "_weighted": F.when(F.col("_at") == 0, F.col(value)).otherwise(F.col(value) * (1 - decay)),
        }
    )
    sums = placed.groupBy(*keys, "_part").agg(
        F.sum(F.col("_weighted") * F.pow(F.lit(decay), length - 1 - F.col("_local"))).alias("_weighted")
    )
    handed = _handed_over(sums, keys, decay**length)
    # What a block is handed sits one position before its start.
    carried = handed.withColumn("_local", F.lit(-1).cast("long"))
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_local")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scaled = F.sum(F.col("_weighted") * F.pow(F.lit(decay), -F.col("_local"))).over(inside)
    return (
        _with_carried(placed, carried)
        .withColumn(name, F.pow(F.lit(decay), F.col("_local")) * scaled)
        .where(~F.col("_carried"))
        .select(*df.columns, name)
    )


def _handed_over(sums: DataFrame, keys: Sequence[str], weight: float) -> DataFrame:
    """What each block is handed: the blocks before it, each decayed by ``weight`` per block.

    With a small weight, the largest double vanishes below the smallest after a known number
    of blocks, so every block adds to that many that follow, and equal places are summed.
    Otherwise blocks have their full length, and a series has one number per ``block_rows``
    rows, over which the recurrence itself runs.
    """
    if weight < 1e-30:
        reach = math.ceil((math.log(5e-324) - math.log(1.7e308)) / math.log(max(weight, 5e-324)))
        shares = F.array(
            *[
                F.struct((F.col("_part") + k).alias("_part"), _decayed(F.col("_weighted"), weight, k - 1).alias("_weighted"))
                for k in range(1, reach + 1)
            ]
        )
        spread = sums.select(*keys, F.explode(shares).alias("_share")).select(*keys, "_share.*")
        return spread.groupBy(*keys, "_part").agg(F.sum("_weighted").alias("_weighted"))
    ordered = sums.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_part", "_weighted"))).alias("_blocks")
    )
    start = F.struct(F.lit(0.0).alias("now"), F.array().cast("array<double>").alias("all"))
    handed = F.aggregate(
        "_blocks",
        start,
        lambda state, block: F.struct(
            (state["now"] * weight + block["_weighted"]).alias("now"),
            F.array_append(state["all"], state["now"] * weight + block["_weighted"]).alias("all"),
        ),
        lambda state: state["all"],
    )
    return ordered.select(*keys, F.posexplode(handed).alias("_at", "_weighted")).select(
        *keys, (F.col("_at") + 1).cast("long").alias("_part"), "_weighted"
    )


def _decayed(value: Column, weight: float, times: int) -> Column:
    """Decay step by step: the product of the weights alone would vanish too early."""
    for _ in range(times):
        value = value * F.lit(weight)
    return value
