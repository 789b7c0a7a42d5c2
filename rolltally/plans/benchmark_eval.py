"""In-training evaluation: each dataset is scored by what its columns make it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.operators import benchmarks
from rolltally.operators.contracts import dataset_kind
from rolltally.operators.joins import attach_responses_by_index, attach_responses_by_prompt, last_per_key
from rolltally.sources.sinks import summary_row, write_jsonl, write_summary


def evaluate(
    datasets: DataFrame | dict[str, DataFrame],
    responses: DataFrame | dict[str, DataFrame],
    strict: Callable[..., Column] | None = None,
    loose: Callable[..., Column] | None = None,
    prefix: str = "eval",
) -> DataFrame:
    """Metric rows (name, value) of one dataset, or of several under prefixed names.

    Instruction datasets need a ``strict`` and a ``loose`` scorer: functions of
    (prompt, response, instruction_id_list, kwargs) to ``array<boolean>``, usually a
    ``pandas_udf``. Generic datasets report the mean of their ``loss`` column.
    """
    if isinstance(datasets, dict):
        parts = [
            evaluate(df, responses.get(name), strict, loose, f"{prefix}_{name}")
            for name, df in datasets.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    kind = dataset_kind(datasets)
    if kind == "instruction":
        metrics = instruction_benchmark(datasets, responses, strict, loose)
    elif kind == "multiple_choice":
        metrics = benchmarks.choice_metrics(choice_benchmark(datasets, responses))
    else:
        metrics = datasets.agg(F.avg("loss").alias("loss"))
    return benchmarks.metric_rows(metrics, prefix)


def choice_benchmark(examples: DataFrame, responses: DataFrame) -> DataFrame:
    """Scored rows of a multiple-choice dataset.

    Responses carry ``row_index``, ``response`` and ``arrival``; a repeated index keeps
    its last response.
    """
    kept = last_per_key(responses.select("row_index", "response", "arrival"), ["row_index"], "arrival")
    return benchmarks.score_choices(attach_responses_by_index(examples, kept))


def instruction_benchmark(
    examples: DataFrame,
    responses: DataFrame,
    strict: Callable[..., Column],
    loose: Callable[..., Column],
) -> DataFrame:
    """Strict and loose metrics of an instruction dataset."""
    return benchmarks.strict_and_loose_metrics(instruction_rows(examples, responses, strict, loose))


def instruction_rows(
    examples: DataFrame,
    responses: DataFrame,
    strict: Callable[..., Column],
    loose: Callable[..., Column],
) -> DataFrame:
    """Examples with response, ``strict_list`` and ``loose_list``.

    Responses carry ``key``, ``prompt`` and ``response``; with an ``arrival`` column a
    repeated key keeps its last row. Of several keys with one prompt the highest counts.
    """
    if "arrival" in responses.columns:
        kept = responses.select("key", "prompt", "response", "arrival")
        responses = last_per_key(kept, ["key"], "arrival")
    inputs = [F.col(c) for c in ("prompt", "response", "instruction_id_list", "kwargs")]
    answered = attach_responses_by_prompt(examples, responses, "key", ["key"])
    return answered.withColumns({"strict_list": strict(*inputs), "loose_list": loose(*inputs)})


def verdict_rows(scored: DataFrame, verdicts: str) -> DataFrame:
    """Result lines of one scoring: each instruction's verdict and whether all held."""
    return scored.select(
        "key",
        "prompt",
        "response",
        "instruction_id_list",
        F.col(verdicts).alias("follow_instruction_list"),
        F.forall(verdicts, lambda held: held).alias("follow_all_instructions"),
    )


def write_scores(
    files: dict[str, DataFrame], metrics: DataFrame, folder: str, prefix: str, step: int
) -> str:
    """Write result rows as JSON lines and the summary of one evaluation at a step.

    Everything goes below ``<folder>/<prefix>_step_<step, six digits>``, which is returned.
    The summary names its metrics with the prefix and tells where the rows are.
    """
    base = f"{folder.rstrip('/')}/{prefix}_step_{step:06d}"
    for name, rows in files.items():
        write_jsonl(rows, f"{base}/{name}.jsonl", "overwrite")
    named = metrics.withColumnsRenamed({c: f"{prefix}_{c}" for c in metrics.columns})
    places = {f"{name}_path": f"{base}/{name}.jsonl" for name in files}
    write_summary(summary_row(named, {"step": step, **places}), f"{base}/summary.json")
    return base
