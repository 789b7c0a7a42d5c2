"""First rows, unions, seeded samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.functions.fixed_values import SEED
from rolltally.operators.joins import first_per_key

BUCKET_DIGITS = 4


def first_rows(df: DataFrame, n: int, index: str) -> DataFrame:
    """The first ``min(n, rows)`` rows in index order."""
    return df.orderBy(index).limit(n)


def seeded_key(row_id: Column, seed: int = SEED) -> Column:
    """Reproducible pseudo-random order key of a row."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, n: int, row_id: str, seed: int = SEED) -> DataFrame:
    """``n`` rows in seeded order."""
    return df.orderBy(seeded_key(F.col(row_id), seed)).limit(n)


def sample_unique_prompts(
    df: DataFrame, n: int, index: str, prompt: str = "prompt", seed: int = SEED
) -> DataFrame:
    """``n`` rows in seeded order after keeping the first row of every prompt."""
    return seeded_sample(first_per_key(df, [prompt], index), n, index, seed)


def seeded_split(
    df: DataFrame, test_fraction: float, row_id: str, seed: int = SEED, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add ``split``: the first ``ceil(rows * test_fraction)`` rows in seeded order are
    ``test``, the others ``train``. ``row_id`` must be unique.

    The order is never carried out over all rows. Hash prefixes are counted (16^digits
    buckets at most), the bucket in which the split falls is found from their running
    counts, and only that bucket is ranked. The large table itself is not shuffled: it
    meets a table of bucket bounds whose size is fixed.
    """
    hashed = df.withColumn("_hash", seeded_key(F.col(row_id), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # At most 16^digits rows, so one ordered pass over them is small.
    everything = Window.partitionBy(F.lit(0))
    running = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.ceil(F.sum("_rows").over(everything) * F.lit(test_fraction))
    bounds = counts.select(
        "_bucket",
        (wanted - (F.sum("_rows").over(running) - F.col("_rows"))).alias("_open"),
        "_rows",
    )
    # All of a bucket, none of it, or (one bucket only) its first rows go to the test set.
    divided = bounds.where((F.col("_open") > 0) & (F.col("_open") < F.col("_rows")))
    ranked = hashed.select("_hash", "_bucket").join(F.broadcast(divided), "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_hash")
    last = (
        ranked.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == F.col("_open"))
        .select("_bucket", F.col("_hash").alias("_last"))
    )
    cuts = bounds.join(F.broadcast(last), "_bucket", "left").select("_bucket", "_open", "_rows", "_last")
    is_test = (F.col("_open") >= F.col("_rows")) | (
        (F.col("_open") > 0) & F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False))
    )
    return (
        hashed.join(F.broadcast(cuts), "_bucket", "left")
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .select(*df.columns, "split")
    )


def union_named(datasets: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Rows of several datasets with the name of each; absent columns become null."""
    labelled = [df.withColumn(name, F.lit(label)) for label, df in datasets.items()]
    united = labelled[0]
    for other in labelled[1:]:
        united = united.unionByName(other, allowMissingColumns=True)
    return united


def prefixed_metrics(
    metrics: DataFrame, values: Sequence[str], prefix: str = "eval", name: str = "dataset"
) -> DataFrame:
    """Metrics per dataset as rows (name, value), named ``<prefix>_<dataset>_<metric>``."""
    pairs = F.array(
        *[
            F.struct(
                F.concat(F.lit(f"{prefix}_"), F.col(name), F.lit(f"_{value}")).alias("name"),
                F.col(value).cast("double").alias("value"),
            )
            for value in values
        ]
    )
    return metrics.select(F.inline(pairs)).where(F.col("value").isNotNull())


def checkpoint_sweep(
    scores: DataFrame, score: Column, model: str = "model", checkpoint: str = "checkpoint"
) -> DataFrame:
    """One score per model and checkpoint in a single pass, the base model (null
    checkpoint) first and checkpoints by number."""
    number = F.regexp_extract(F.col(checkpoint), r"(\d+)$", 1).try_cast("long")
    return (
        scores.groupBy(model, checkpoint)
        .agg(score.alias("score"), F.count(F.lit(1)).alias("num_rows"))
        .withColumn("step", number)
        .orderBy(model, F.col("step").asc_nulls_first())
    )
