import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolltally.operators import benchmarks, grading
from rolltally.plans.benchmark_eval import evaluate, instruction_rows, verdict_rows, write_scores
from rolltally.plans.math_eval import evaluate_benchmark, evaluate_math, join_gold

NONE = "[No boxed answer found]"
SCHEMA = "run string, problem_id long, sample_idx int, text string, gold string"


def box(answer):
    return "thinking" if answer is None else f"so \\boxed{{{answer}}}"


def samples(spark, answers, gold="1", run="r"):
    """``answers``: list of answer lists per problem; None has no box."""
    rows = [
        (run, p, i, box(a), gold) for p, given in enumerate(answers) for i, a in enumerate(given)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def results(spark, answers, gold="1"):
    got = grading.problem_results(samples(spark, answers, gold)).orderBy("problem_id").collect()
    return [(r["num_correct"], r["num_formatted"], r["majority_answer"], r["majority_correct"]) for r in got]


def test_vote_and_counts(spark):
    assert results(
        spark,
        [
            ["2", "1", "1", "2"],
            ["1", "2", "2", "1"],
            [None, None],
            ["", "", "1"],
            ["1.0", "1", "2", "2"],
            [None, "1"],
            [NONE, "", "3", "3"],
        ],
    ) == [
        (2, 4, "2", False),
        (2, 4, "1", True),
        (0, 0, None, False),
        (1, 3, NONE, False),
        (2, 4, "2", False),
        (1, 1, "1", True),
        (0, 4, NONE, False),
    ]


def test_empty_gold_is_met_by_nothing(spark):
    # Neither an empty box nor a full one equals an answer that is not there.
    assert results(spark, [["", "7"]], gold="") == [(0, 2, NONE, False)]


def test_against_brute_force(spark):
    rng = random.Random(11)
    pool = [None, "", "1", "1.0", "2", "\\frac{2}{2}", "x"]
    answers = [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    right = {"1", "1.0", "\\frac{2}{2}"}
    expected = []
    for given in answers:
        shown = [a or NONE for a in given if a is not None]
        vote = Counter(shown).most_common(1)[0][0] if shown else None
        expected.append((sum(a in right for a in given), len(shown), vote, vote in right))
    assert results(spark, answers) == expected


def test_hot_problem_equals_small_ones(spark):
    # One problem holds most samples; nothing about it is special.
    rows = spark.range(5000).select(
        F.lit("r").alias("run"),
        F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 10).cast("long").alias("problem_id"),
        F.col("id").cast("int").alias("sample_idx"),
        F.concat(F.lit("\\boxed{"), (F.col("id") % 3).cast("string"), F.lit("}")).alias("text"),
        F.lit("1").alias("gold"),
    )
    hot = grading.problem_results(rows).where("problem_id = 0").first()
    assert hot["num_samples"] == 4000 + 100
    nested = grading.nested_results(grading.grade_samples(rows), part_rows=50)
    sizes = nested.select(F.max(F.size("generations")), F.sum(F.size("generations"))).first()
    assert tuple(sizes) == (50, 5000)


def test_metrics_and_order(spark):
    both = samples(spark, [["1", "2"], ["2", "2"], ["1", "1"], [None, "1"]]).union(
        samples(spark, [["1", "1"]], run="s")
    )
    evaluation = evaluate_math(both, val_n=2, progress_every=2)
    metrics = {r["run"]: r for r in evaluation.metrics.collect()}
    assert metrics["r"]["pass_at_n_pct"] == 75.0
    assert metrics["r"]["average_at_n_pct"] == 50.0
    assert metrics["r"]["majority_vote_at_n_pct"] == 75.0
    assert metrics["r"]["format_rate"] == 87.5
    assert metrics["r"]["total_solutions"] == 8
    assert all(m["pass_at_n_pct"] >= m["average_at_n_pct"] for m in metrics.values())
    progress = evaluation.progress.where("run = 'r'").orderBy("problem_id").collect()
    assert [(r["problem_id"], r["pass_at_n_pct"], r["average_at_n_pct"]) for r in progress] == [
        (1, 50.0, 25.0),
        (3, 75.0, 50.0),
    ]


def test_requested_samples_count_even_if_fewer_came(spark):
    metrics = evaluate_math(samples(spark, [["1"]]), val_n=4).metrics.first()
    assert metrics["average_at_n_pct"] == 25.0 and metrics["format_rate"] == 25.0


def test_nested_results_keep_order_and_first_sample(spark):
    graded = grading.grade_samples(samples(spark, [["2", "1", None]]))
    row = grading.nested_results(graded).first()
    assert [g["predicted_answer"] for g in row["generations"]] == ["2", "1", NONE]
    assert [g["correct"] for g in row["generations"]] == [False, True, False]
    assert (row["predicted_answer"], row["correct"], row["formatted"]) == ("2", False, True)
    parts = grading.nested_results(graded, part_rows=2).orderBy("part").collect()
    assert [len(p["generations"]) for p in parts] == [2, 1]
    # The fields of the problem are those of its first sample on every part.
    assert [(p["predicted_answer"], p["correct"], p["formatted"]) for p in parts] == [("2", False, True)] * 2


def test_problems_without_samples_count(spark):
    generations = samples(spark, [["0"], ["5"]]).drop("gold")
    benchmark = spark.createDataFrame([(0, "0"), (7, "7")], "problem_id long, gt_answer string")
    got = evaluate_benchmark(generations, benchmark, ["r", "none"], 1).orderBy("run").collect()
    assert [(r["run"], r["num_problems"], r["pass_at_n"], r["num_without_gold"]) for r in got] == [
        ("none", 2, 0, 0),
        ("r", 2, 1, 1),
    ]


def test_metrics_on_empty_input(spark):
    empty = samples(spark, [["1"]]).limit(0)
    assert evaluate_math(empty, 1).metrics.count() == 0
    lists = spark.createDataFrame([], "follow_list array<boolean>")
    assert tuple(benchmarks.instruction_metrics(lists).first()) == (0.0, 0.0, 0, 0)


def test_instruction_levels(spark):
    rows = [([True, True],), ([True, False, True],), ([],)]
    lists = spark.createDataFrame(rows, "follow_list array<boolean>")
    got = benchmarks.instruction_metrics(lists).first()
    assert got["prompt_level"] == pytest.approx(2 / 3)
    assert got["instruction_level"] == pytest.approx(4 / 5)
    assert (got["num_prompts"], got["num_instructions"]) == (3, 5)


def test_gain_over_base(spark):
    # The published scores of one benchmark.
    scores = spark.createDataFrame(
        [("AIME24", s, v) for s, v in [(0, 51.5), (25, 51.4), (50, 52.8), (75, 54.4), (100, 57.2)]],
        "benchmark string, step int, score double",
    )
    got = grading.gain_over_base(scores).orderBy("step").collect()
    assert [round(r["gain_over_base"], 1) for r in got] == [0.0, -0.1, 1.3, 2.9, 5.7]
    assert got[0]["gain_over_previous"] is None and round(got[4]["gain_over_previous"], 1) == 2.8


def test_gold_join(spark):
    generations = samples(spark, [["1"]]).drop("gold")
    benchmark = spark.createDataFrame([(0, "1")], "problem_id long, gt_answer string")
    assert join_gold(generations, benchmark).first()["gold"] == "1"


def choice_rows(spark):
    examples = spark.createDataFrame(
        [(0, "p0", "b", "m"), (1, "p1", "A", "n"), (2, "p2", None, "n")],
        "row_index long, prompt string, answer string, src string",
    )
    responses = spark.createDataFrame(
        [(0, "Answer: A", 1), (0, "Answer: B", 2), (2, "Answer: C", 3)],
        "row_index long, response string, arrival long",
    )
    return examples, responses


def test_evaluation_routes_by_columns(spark):
    rules = spark.createDataFrame(
        [(1, "p", ["a", "b"], [{"x": "1"}, {}]), (2, "q", ["a"], [{}])],
        "key long, prompt string, instruction_id_list array<string>, kwargs array<map<string,string>>",
    )
    said = spark.createDataFrame([(1, "p", "yes")], "key long, prompt string, response string")

    def scorer(prompt, response, ids, kwargs):
        return F.transform(ids, lambda _: response == "yes")

    examples, responses = choice_rows(spark)
    plain = spark.createDataFrame([(1.0,), (2.0,)], "loss double")
    rows = evaluate(
        {"mc": examples, "ifeval": rules, "plain": plain},
        {"mc": responses, "ifeval": said},
        scorer,
        scorer,
    )
    got = {r["name"]: r["value"] for r in rows.collect()}
    assert got == {
        "eval_mc_mc_accuracy": pytest.approx(1 / 3),
        "eval_mc_mc_extraction_rate": pytest.approx(2 / 3),
        "eval_mc_mc_num_prompts": 3.0,
        "eval_mc_mc_missing_prompts": 1.0,
        "eval_ifeval_strict_prompt_level": 0.5,
        "eval_ifeval_strict_instruction_level": pytest.approx(2 / 3),
        "eval_ifeval_loose_prompt_level": 0.5,
        "eval_ifeval_loose_instruction_level": pytest.approx(2 / 3),
        "eval_ifeval_num_prompts": 2.0,
        "eval_ifeval_num_instructions": 3.0,
        "eval_ifeval_missing_prompts": 1.0,
        "eval_plain_loss": 1.5,
    }


def test_missing_counts_appear_only_when_positive(spark):
    examples, responses = choice_rows(spark)
    rows = evaluate(examples.where("row_index <> 1"), responses)
    assert not [r["name"] for r in rows.collect() if "missing" in r["name"]]


def test_repeated_keys_and_verdict_lines(spark, tmp_path):
    import json

    rules = spark.createDataFrame(
        [(1, "p", ["a", "b"], [{}, {}])],
        "key long, prompt string, instruction_id_list array<string>, kwargs array<map<string,string>>",
    )
    said = spark.createDataFrame(
        [(1, "p", "new", 2), (1, "p", "old", 1)], "key long, prompt string, response string, arrival long"
    )

    def strict(prompt, response, ids, kwargs):
        return F.transform(ids, lambda i: (response == "new") & (i == "a"))

    def loose(prompt, response, ids, kwargs):
        return F.transform(ids, lambda _: response == "new")

    scored = instruction_rows(rules, said, strict, loose)
    lines = {name: verdict_rows(scored, f"{name}_list") for name in ("strict", "loose")}
    metrics = benchmarks.strict_and_loose_metrics(scored)
    base = write_scores(lines, metrics, str(tmp_path), "eval_rules", 25)
    assert base.endswith("/eval_rules_step_000025")

    def stored(name):
        (part,) = [p for p in (tmp_path / "eval_rules_step_000025" / name).glob("part-*") if p.stat().st_size]
        return json.loads(part.read_text())

    assert stored("strict.jsonl")["follow_instruction_list"] == [True, False]
    assert stored("strict.jsonl")["follow_all_instructions"] is False
    assert stored("loose.jsonl")["follow_all_instructions"] is True
    summary = stored("summary.json")
    assert summary["eval_rules_strict_instruction_level"] == 0.5 and summary["step"] == 25
    assert summary["strict_path"] == f"{base}/strict.jsonl"


def test_equal_pairs_are_compared_once(spark, monkeypatch):
    pairs = [("0.5", r"\frac{1}{2}", True), ("2", "3", False), (None, "3", False), ("2", None, False), (None, None, False), ("", "", False)]
    rows = [(i, *pairs[i % len(pairs)][:2]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, left string, right string").repartition(4)
    got = grading.grade_pairs(df, "left", "right", "equal")
    assert got.columns == ["id", "left", "right", "equal"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(*row, pairs[row[0] % len(pairs)][2]) for row in rows]
    monkeypatch.setattr(grading, "grade", lambda a, b: F.uuid())
    assert grading.grade_pairs(df, "left", "right", "mark").select("mark").distinct().count() == len(pairs)
