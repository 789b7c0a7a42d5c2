"""Maths evaluation: generated samples to run metrics, progress and nested results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolltally.operators import grading
from rolltally.sources.sinks import summary_row, write_jsonl, write_summary


@dataclass(frozen=True)
class MathEvaluation:
    """Results of one evaluation, each planned when it is first asked for.

    Planning runs nothing but for ``progress``, whose running totals write a table.
    """

    samples: DataFrame
    val_n: int
    progress_every: int = 10
    expressions: bool = True

    @cached_property
    def graded(self) -> DataFrame:
        return grading.grade_samples(self.samples, expressions=self.expressions)

    @cached_property
    def problems(self) -> DataFrame:
        return grading.problem_results(self.samples, expressions=self.expressions)

    @cached_property
    def metrics(self) -> DataFrame:
        return grading.run_metrics(self.problems, self.val_n)

    @cached_property
    def progress(self) -> DataFrame:
        return grading.running_metrics(self.problems, self.val_n, every=self.progress_every)

    @cached_property
    def nested(self) -> DataFrame:
        golds = self.samples.groupBy("run", "problem_id").agg(F.min("gold").alias("gold"))
        return grading.result_records(grading.nested_results(self.graded), self.problems, golds, self.val_n)


def evaluate_math(samples: DataFrame, val_n: int, progress_every: int = 10, expressions: bool = True) -> MathEvaluation:
    """Evaluate samples (run, problem_id, sample_idx, text, gold).

    ``problem_id`` is the 0-based position of the problem in its benchmark. Answers are
    compared as expressions too, unless ``expressions`` is off, for plain numbers.
    """
    return MathEvaluation(samples, val_n, progress_every, expressions)


def evaluate_benchmark(
    generations: DataFrame, benchmark: DataFrame, runs: Sequence[str], val_n: int
) -> DataFrame:
    """Metrics of named runs over all problems of a benchmark, answered or not.

    Generations without a problem in the benchmark are not graded but counted, as
    ``num_without_gold``.
    """
    results = grading.problem_results(join_gold(generations, benchmark))
    # A row per run and problem is what is evaluated; the runs are a list of names.
    expected = benchmark.select("problem_id", F.explode(F.array(*[F.lit(r) for r in runs])).alias("run"))
    metrics = grading.run_metrics(grading.complete_results(results, expected), val_n)
    strays = generations.join(benchmark.select("problem_id"), "problem_id", "left_anti")
    counted = strays.groupBy("run").agg(F.count(F.lit(1)).alias("num_without_gold"))
    return metrics.join(counted, "run", "left").fillna(0, ["num_without_gold"])


def join_gold(generations: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Generations (run, problem_id, sample_idx, text) with the gold answer of their problem.

    The problems of a benchmark are few beside the samples; the join is left to Catalyst,
    which broadcasts them if their size allows it and else shuffles both sides, splitting
    skewed problems.
    """
    gold = benchmark.select("problem_id", F.col("gt_answer").alias("gold"))
    return generations.join(gold, "problem_id")


def write_evaluation(evaluation: MathEvaluation, path: str, config: dict) -> None:
    """Write the summary document and, beside it, the nested results as JSON lines."""
    write_jsonl(evaluation.nested, f"{path}/results", "overwrite")
    write_summary(summary_row(evaluation.metrics, config), f"{path}/summary")
