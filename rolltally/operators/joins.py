"""Lookups that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 32


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join every row to a table that has one row per key.

    Keys with at least ``hot_rows`` rows on the left are spread over ``salts`` tasks, each
    with its own copy of the looked-up row. ``salt_by`` names columns that tell the rows
    of a key apart. The list of hot keys has at most rows / ``hot_rows`` entries of eight
    bytes, which bounds what is broadcast. Null keys equal each other.
    """
    keyed = left.withColumn("_key", F.xxhash64(*on))
    hot = (
        keyed.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= hot_rows)
        .select("_key", F.lit(True).alias("_hot"))
    )
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    salted = keyed.join(F.broadcast(hot), "_key", "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    spread = (
        lookup.withColumn("_key", F.xxhash64(*on))
        .join(F.broadcast(hot), "_key", "left")
        .withColumn("_right_salt", F.explode(copies))
        .drop("_hot")
        .withColumnsRenamed({"_key": "_right_key", **{c: f"_right_{c}" for c in on}})
    )
    same = (F.col("_key") == F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt"))
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    added = [c for c in lookup.columns if c not in on]
    return salted.join(spread, same, how).select(*left.columns, *added)


def with_group_values(
    df: DataFrame,
    by: Sequence[str],
    values: dict[str, Column],
    salt_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Add aggregates of each row's group without gathering the group in one task."""
    totals = df.groupBy(*by).agg(*[value.alias(name) for name, value in values.items()])
    return lookup_join(df, totals, by, salt_by, "inner", hot_rows, salts)


def group_values(df: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add aggregates of each row's group; null keys equal each other.

    The totals have one row per group and the join is left to adaptive execution: it
    broadcasts them while they are small and splits a group that holds many rows.
    """
    totals = df.groupBy(*by).agg(*[value.alias(name) for name, value in values.items()])
    totals = totals.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return df.join(totals, same, "left").select(*df.columns, *values)


def last_per_key(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """Keep the row of each key that arrived last. Partial aggregation keeps one row per
    key and task before the shuffle."""
    return _one_per_key(df, key, lambda row: F.max_by(row, F.col(order_by)))


def first_per_key(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """Keep the row of each key that comes first in order."""
    return _one_per_key(df, key, lambda row: F.min_by(row, F.col(order_by)))


def _one_per_key(
    df: DataFrame, key: Sequence[str], choose: Callable[[Column], Column]
) -> DataFrame:
    """One chosen row per key. Choosing whole rows aggregates by sorting, so the hash of
    the key leads the order: long texts are compared only where hashes are equal."""
    columns = [c for c in df.columns if c not in key]
    kept = df.groupBy(F.xxhash64(*key).alias("_key"), *key).agg(
        choose(F.struct(*columns)).alias("_row")
    )
    return kept.select(*key, "_row.*").select(*df.columns)


def attach_responses_by_index(
    examples: DataFrame, responses: DataFrame, index: str = "row_index"
) -> DataFrame:
    """Examples with the response of the same index; an absent one is ``""`` and marked."""
    found = responses.select(index, F.col("response"), F.lit(True).alias("_found"))
    return _mark_missing(examples.join(found, index, "left"))


def attach_responses_by_prompt(
    examples: DataFrame,
    responses: DataFrame,
    arrival: str,
    salt_by: Sequence[str],
    keep_missing: bool = True,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Examples with the last response to their prompt text.

    With ``keep_missing`` an unanswered prompt has the response ``""`` and is marked;
    without it such examples drop out.
    """
    answered = last_per_key(responses.select("prompt", "response", arrival), ["prompt"], arrival)
    found = answered.select("prompt", "response", F.lit(True).alias("_found"))
    how = "left" if keep_missing else "inner"
    joined = lookup_join(examples, found, ["prompt"], salt_by, how, hot_rows, salts)
    return _mark_missing(joined)


def _mark_missing(joined: DataFrame) -> DataFrame:
    return joined.withColumns(
        {
            "response": F.coalesce("response", F.lit("")),
            "missing": F.col("_found").isNull(),
        }
    ).drop("_found")


def zip_by_index(left: DataFrame, right: DataFrame, index: Sequence[str]) -> DataFrame:
    """Pair rows of two tables that carry the same explicit position.

    A position that only one of them has fails the job, as the tables do not belong together.
    """
    keys = list(index)
    both = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), keys, "full")
    alone = F.col("_left").isNull() | F.col("_right").isNull()
    place = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    stop = F.raise_error(F.concat(F.lit("No counterpart at position "), place)).cast("boolean")
    return both.where(F.when(alone, stop).otherwise(F.lit(True))).drop("_left", "_right")
