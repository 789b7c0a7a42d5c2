"""From generated samples to graded samples, problem results and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.functions.answers import boxed_last_marker, grade, shown_answer
from rolltally.functions.text import count_when
from rolltally.operators.ordering import running_totals

PART_ROWS = 256


def grade_samples(df: DataFrame, text: str = "text", gold: str = "gold", expressions: bool = True) -> DataFrame:
    """Add ``predicted``, ``is_formatted``, ``is_correct`` and the ``shown`` answer.

    An empty box counts as formatted and is shown as the placeholder.
    """
    predicted = F.col("predicted")
    return df.withColumn("predicted", boxed_last_marker(F.col(text))).withColumns(
        {
            "is_formatted": predicted.isNotNull(),
            "is_correct": F.coalesce(grade(predicted, F.col(gold), expressions), F.lit(False)),
            "shown": shown_answer(predicted),
        }
    )


def grade_pairs(df: DataFrame, predicted: str, gold: str, name: str, tasks: int = 64) -> DataFrame:
    """Rows with ``name``, whether their two answers are equal; equal pairs of answers are compared once.

    Comparing a pair costs thousands of times what counting it does, and samples repeat answers.
    ``tasks`` share the distinct pairs: each is costly, few bytes as they are.
    """
    pairs = df.select(predicted, gold).distinct().repartition(tasks)
    graded = pairs.select(F.col(predicted).alias("_predicted"), F.col(gold).alias("_gold"), grade(F.col(predicted), F.col(gold)).alias(name))
    same = F.col(predicted).eqNullSafe(F.col("_predicted")) & F.col(gold).eqNullSafe(F.col("_gold"))
    return df.join(graded, same).drop("_predicted", "_gold")


def problem_results(
    df: DataFrame,
    problem: Sequence[str] = ("run", "problem_id"),
    text: str = "text",
    gold: str = "gold",
    sample_idx: str = "sample_idx",
    expressions: bool = True,
) -> DataFrame:
    """One row per problem from raw samples: counts and the majority vote.

    Equal answers are counted first, so each distinct answer of a problem is graded once
    and a problem with very many samples is reduced before it is gathered. The vote is
    among formatted answers; of equally frequent ones the first seen wins.
    """
    predicted = boxed_last_marker(F.col(text))
    answers = (
        df.select(*problem, gold, sample_idx, predicted.alias("predicted"))
        .withColumns(
            {
                "shown": shown_answer(F.col("predicted")),
                "is_formatted": F.col("predicted").isNotNull(),
            }
        )
        .groupBy(*problem, gold, "shown", "is_formatted")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_when(F.col("predicted") == "").alias("n_empty"),
            F.min(sample_idx).alias("first"),
        )
    )
    # The placeholder stands for empty boxes too, and nothing equals the empty text.
    right = F.when(F.col("is_formatted"), grade(F.col("shown"), F.col(gold), expressions)).otherwise(F.lit(False))
    graded = answers.withColumn("right", right).withColumn("correct", (F.col("n") - F.col("n_empty")) * F.col("right").cast("long"))
    vote = F.max(
        F.when(
            F.col("is_formatted"),
            F.struct(
                F.col("n"),
                (-F.col("first")).alias("earliness"),
                F.col("shown").alias("answer"),
                F.col("right"),
            ),
        )
    )
    return (
        graded.groupBy(*problem)
        .agg(
            F.sum("n").alias("num_samples"),
            F.sum("correct").alias("num_correct"),
            F.sum(F.when(F.col("is_formatted"), F.col("n")).otherwise(F.lit(0))).alias("num_formatted"),
            vote.alias("_vote"),
        )
        .select(
            *problem,
            "num_samples",
            "num_correct",
            "num_formatted",
            (F.col("num_correct") > 0).alias("has_correct"),
            F.col("_vote.answer").alias("majority_answer"),
            F.coalesce("_vote.right", F.lit(False)).alias("majority_correct"),
        )
    )


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def run_metrics(results: DataFrame, val_n: int, by: Sequence[str] = ("run",)) -> DataFrame:
    """Pass@n, average@n, majority@n and format rate per run.

    Totals use the requested ``val_n`` samples per problem.
    """
    counted = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_problems"),
        count_when(F.col("has_correct")).alias("pass_at_n"),
        F.sum("num_correct").alias("average_at_n"),
        count_when(F.col("majority_correct")).alias("majority_vote_at_n"),
        F.sum("num_formatted").alias("formatted_count"),
    )
    problems, total = F.col("num_problems"), F.col("num_problems") * val_n
    return counted.withColumns(
        {
            "total_solutions": total,
            "pass_at_n_pct": percent(F.col("pass_at_n"), problems),
            "average_at_n_pct": percent(F.col("average_at_n"), total),
            "majority_vote_at_n_pct": percent(F.col("majority_vote_at_n"), problems),
            "format_rate": percent(F.col("formatted_count"), total),
        }
    )


def nested_results(
    graded: DataFrame,
    problem: Sequence[str] = ("run", "problem_id"),
    sample_idx: str = "sample_idx",
    text: str = "text",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Rows with nested ``generations``, in sample order.

    A problem fills one row per ``part_rows`` sample positions (``part`` 0, 1, …), so a
    row stays bounded however many samples a problem has; usual runs have part 0 only.
    The fields of the problem's first sample are copied out on each of its parts.
    """
    position = F.col(sample_idx)

    def part_of(place: Column) -> Column:
        return ((place - F.pmod(place, F.lit(part_rows))) / part_rows).cast("int")

    sample = F.struct(
        position.alias("sample_idx"),
        F.col("shown").alias("predicted_answer"),
        F.col(text).alias("full_generation"),
        F.col("is_correct").alias("correct"),
        F.col("is_formatted").alias("formatted"),
    )
    nested = (
        graded.withColumn("part", part_of(position))
        .groupBy(*problem, "part")
        .agg(F.array_sort(F.collect_list(sample)).alias("generations"))
    )
    fields = ("predicted_answer", "full_generation", "correct", "formatted")
    first = F.get("generations", F.lit(0))
    begins = graded.groupBy(*problem).agg(part_of(F.min(sample_idx)).alias("part"))
    leads = nested.join(begins, [*problem, "part"]).select(*problem, *[first[f].alias(f) for f in fields])
    return nested.join(leads, list(problem)).select(
        *problem,
        "part",
        F.transform("generations", lambda g: F.struct(*[g[f].alias(f) for f in fields])).alias("generations"),
        *fields,
    )


def result_records(
    nested: DataFrame,
    results: DataFrame,
    problems: DataFrame,
    val_n: int,
    problem: Sequence[str] = ("run", "problem_id"),
) -> DataFrame:
    """Whole result records: nested rows with what is known of their problem.

    ``results`` are problem results; ``problems`` has the problem columns that exist of
    ``problem_id``, ``problem``, ``question_id`` and ``gold``, one row per problem.
    """
    judged = results.select(
        *problem,
        "num_correct",
        F.col("has_correct").alias("pass_at_n"),
        F.col("majority_correct").alias("majority_vote_correct"),
    )
    known = [F.col("gold").alias("ground_truth")]
    if "problem" in problems.columns:
        known.append(F.col("problem"))
    question = F.col("question_id") if "question_id" in problems.columns else F.lit(None)
    known.append(result_id(question, F.col("problem_id")).alias("id"))
    keys = [c for c in problem if c in problems.columns]
    return (
        nested.join(judged, list(problem))
        .join(problems.select(*keys, *known), keys)
        .withColumn("val_n", F.lit(val_n))
    )


def complete_results(
    results: DataFrame, expected: DataFrame, problem: Sequence[str] = ("run", "problem_id")
) -> DataFrame:
    """Results of all expected problems; one that has no sample counts as answered by none."""
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("num_samples", "num_correct", "num_formatted")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_correct", "majority_correct")}
    return expected.select(*problem).join(results, list(problem), "left").withColumns({**counts, **flags})


def result_id(question_id: Column, index: Column) -> Column:
    """Id of a problem, falling back on its position."""
    return F.coalesce(question_id.cast("string"), index.cast("string"))


def running_metrics(
    results: DataFrame,
    val_n: int,
    run: Sequence[str] = ("run",),
    index: str = "problem_id",
    every: int | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Pass@n, average@n and format rate after each problem of a run, in index order.

    ``every`` keeps every so-manieth problem, as for progress reports.
    """
    totals = {
        "seen": F.lit(1).cast("long"),
        "passed": F.col("has_correct").cast("long"),
        "correct": F.col("num_correct"),
        "formatted": F.col("num_formatted"),
    }
    summed = running_totals(results, index, totals, run, blocks)
    if every is not None:
        summed = summed.where(F.pmod(F.col("seen"), F.lit(every)) == 0)
    seen, total = F.col("seen"), F.col("seen") * val_n
    return summed.withColumns(
        {
            "pass_at_n_pct": percent(F.col("passed"), seen),
            "average_at_n_pct": percent(F.col("correct"), total),
            "format_rate": percent(F.col("formatted"), total),
        }
    )


def gain_over_base(
    scores: DataFrame, benchmark: str = "benchmark", step: str = "step", score: str = "score"
) -> DataFrame:
    """Add the score gained over the first step and over the step before.

    A benchmark has one row per evaluated checkpoint.
    """
    steps = Window.partitionBy(benchmark).orderBy(step)
    return scores.withColumns(
        {
            "gain_over_base": F.col(score) - F.first(score).over(steps),
            "gain_over_previous": F.col(score) - F.lag(score).over(steps),
        }
    )
