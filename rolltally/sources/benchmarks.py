"""Named maths benchmarks, mapped to (question_id, problem, gt_answer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolltally.functions.answers import boxed_last_marker

# Columns of problem, answer and id in each published benchmark.
COLUMNS = {
    "amo-bench": ("prompt", "answer", "question_id"),
    "aime24": ("problem", "answer", "id"),
    "minerva": ("question", "answer", "id"),
    "amc23": ("question", "answer", "id"),
    "aime25": ("problem", "answer", "problem_idx"),
    "hmmt25": ("problem", "answer", "problem_idx"),
}
MATH500 = "math500"


def adapt_benchmark(df: DataFrame, name: str) -> DataFrame:
    """Bring a benchmark table into the common shape.

    ``math500`` has solutions instead of answers: its answer is the boxed part, or the
    whole solution where nothing usable is boxed. A missing id column gives null ids.
    """
    name = name.lower()
    if name == MATH500:
        solution = F.col("solution")
        return df.select(
            F.lit(None).cast("string").alias("question_id"),
            F.col("problem"),
            F.coalesce(boxed_last_marker(solution), solution).alias("gt_answer"),
        )
    if name not in COLUMNS:
        raise ValueError(f"Unknown dataset: {name}. Choose one of {sorted([MATH500, *COLUMNS])}.")
    problem, answer, identifier = COLUMNS[name]
    known = F.col(identifier) if identifier in df.columns else F.lit(None)
    return df.select(
        known.cast("string").alias("question_id"),
        F.col(problem).alias("problem"),
        F.col(answer).cast("string").alias("gt_answer"),
    )


def union_benchmarks(tables: dict[str, DataFrame]) -> DataFrame:
    """All given benchmarks in one table, with the benchmark's name."""
    adapted = [
        adapt_benchmark(df, name).withColumn("benchmark", F.lit(name.lower()))
        for name, df in tables.items()
    ]
    united = adapted[0]
    for other in adapted[1:]:
        united = united.unionByName(other)
    return united
