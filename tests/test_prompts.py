import pytest
from pyspark.sql import functions as F

from rolltally.functions import fixed_values as fixed
from rolltally.functions.conversation import CHATML, ChatTemplate, message, render_chat
from rolltally.operators import contracts, prompts

STEPS = "Please reason step by step, and put your final answer within \\boxed{}."


@pytest.fixture(scope="module")
def problems(spark):
    return spark.createDataFrame([("1+1?", "It is 2.")], "problem string, solution string")


def only(df, *names):
    row = df.first()
    return row[names[0]] if len(names) == 1 else tuple(row[n] for n in names)


def test_four_wrappings_of_a_problem(spark):
    df = spark.createDataFrame([("P",)], "p string")
    row = df.select(
        prompts.student_text("math", F.col("p")).alias("student"),
        prompts.rl_text(F.col("p")).alias("rl"),
        prompts.eval_text(F.col("p")).alias("eval"),
        prompts.student_text("instruction", F.col("p")).alias("instruction"),
    ).first()
    assert row["student"] == f"Problem: P\n\n{STEPS}"
    assert row["rl"] == f"Problem: P\n{STEPS}"
    assert row["eval"] == f"P\n\n{STEPS}"
    assert row["instruction"] == "P"


def test_teacher_texts(problems):
    bare = prompts.build_prompts(problems, template=None)
    assert only(bare, "teacher_prompt_text") == (
        "Problem: 1+1?\n\nHere is a reference solution to this problem:\n"
        "=== Reference Solution Begin ===\nIt is 2.\n=== Reference Solution End ===\n"
        f"{fixed.TRANSITION}\n{STEPS}"
    )
    reasoned = prompts.build_prompts(problems, template=None, reason_first=True)
    reasoning, transition = only(reasoned, "teacher_reasoning_prompt", "teacher_transition")
    assert reasoning == (
        "Problem: 1+1?\n\nHere is a correct reasoning to this problem:=== Reference Reasoning Start ===\n"
        f"It is 2.\n=== Reference Reasoning End ===\n\n{fixed.REASON_FIRST}"
    )
    assert transition == f"\n{fixed.TRANSITION}\n{STEPS}"
    assert "teacher_prompt_text" not in reasoned.columns


def test_thinking_marker_only_where_off(problems):
    student, teacher = only(prompts.build_prompts(problems), "student_prompt", "teacher_prompt_text")
    assert student.endswith("<|im_start|>assistant\n<think>\n\n</think>\n\n")
    assert teacher.endswith("<|im_start|>assistant\n")
    assert student.startswith("<|im_start|>user\nProblem: 1+1?")


def test_instruction_teacher_falls_back_on_reference(spark):
    rows = [("p", "given", "r"), ("p", " \n", "r"), ("p", None, "r"), ("p", " ", "r"), ("p", "given", None)]
    df = spark.createDataFrame(rows, "prompt string, teacher_prompt string, gpt4_response string")
    built = prompts.build_prompts(
        df, "instruction", "prompt", teacher_reference_column="gpt4_response", template=None
    )
    made = f"p{fixed.REFERENCE_ANSWER_INTRO}r{fixed.REFERENCE_ANSWER_OUTRO}"
    assert [r[0] for r in built.select("teacher_prompt_text").collect()] == ["given", made, made, made, "given"]


def test_instruction_teacher_fails_without_either(spark):
    df = spark.createDataFrame([("p", " ")], "prompt string, teacher_prompt string")
    built = prompts.build_prompts(df, "instruction", "prompt", template=None)
    with pytest.raises(Exception, match="teacher prompt or a reference"):
        built.collect()


def test_null_prompt_fails(spark):
    df = spark.createDataFrame([(None, "s")], "problem string, solution string")
    with pytest.raises(Exception, match="No text in"):
        prompts.build_prompts(df).collect()


def test_shared_prompt_is_one_prompt(problems):
    student, teacher = only(prompts.build_shared_prompts(problems), "student_prompt", "teacher_prompt_text")
    assert student == teacher


def test_sft_and_rl_tables(problems, spark):
    text = only(prompts.build_sft_text(problems), "text")
    assert text == (
        f"<|im_start|>user\n1+1?\n\n{STEPS}<|im_end|>\n<|im_start|>assistant\nIt is 2.<|im_end|>\n"
    )
    rl = prompts.build_rl_prompts(spark.createDataFrame([("q", "a", 1)], "Question string, Answer string, x int"))
    assert rl.columns == ["prompt", "Answer"]


def test_mixed_formats(spark):
    df = spark.createDataFrame([("math", "P"), ("teacher_prompt", "Q")], "f string, p string")
    got = [r[0] for r in df.select(prompts.student_text_mixed(F.col("f"), F.col("p"))).collect()]
    assert got == [f"Problem: P\n\n{STEPS}", "Q"]
    wrong = spark.createDataFrame([("other", "P")], "f string, p string")
    with pytest.raises(Exception, match="Unsupported format other"):
        wrong.select(prompts.student_text_mixed(F.col("f"), F.col("p"))).collect()


def test_template_is_an_argument(spark):
    template = ChatTemplate("[{role}] ", "|", "[reply] ", "(quick)")
    df = spark.createDataFrame([("hi",)], "t string")
    messages = F.array(message("system", F.lit("be")), message("user", F.col("t")))

    def rendered(**options):
        return df.select(render_chat(messages, template, **options)).first()[0]

    assert rendered() == "[system] be|[user] hi|"
    assert rendered(add_generation_marker=True) == "[system] be|[user] hi|[reply] "
    assert rendered(add_generation_marker=True, enable_thinking=False).endswith("[reply] (quick)")
    assert CHATML.generation_marker == "<|im_start|>assistant\n"


def test_contracts(spark):
    df = spark.createDataFrame([("p", "t", 1)], "prompt string, teacher_prompt string, n int")
    assert contracts.require_columns(df, "instruction", "prompt", teacher_prompt_column="teacher_prompt") is df
    with pytest.raises(ValueError, match="lacks problem, solution"):
        contracts.require_columns(df, "math", "problem", "solution")
    with pytest.raises(ValueError, match="lacks None or ref|lacks ref"):
        contracts.require_columns(df, "instruction", "prompt", teacher_reference_column="ref")
    with pytest.raises(ValueError, match="lacks problem;"):
        contracts.require_prompt_column(df, "math", "problem")
    with pytest.raises(TypeError, match="holds int"):
        contracts.require_text_type(df, "n")
    with pytest.raises(KeyError):
        contracts.require_text_type(df, "absent")
    assert contracts.missing_columns(df, ["z", "a", "n"]) == ["a", "z"]


def test_exclusive_options():
    contracts.check_teacher_options("math", reason_first=True)
    with pytest.raises(ValueError, match="math format"):
        contracts.check_teacher_options("instruction", reason_first=True)
    with pytest.raises(ValueError, match="not both"):
        contracts.check_teacher_options(moving_average_teacher=True, fixed_teacher=True)
    with pytest.raises(ValueError, match="No such dataset format"):
        contracts.check_format("csv")


def test_signature_and_kind(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "extra int, prompt int, other int, problem int")
    assert contracts.select_signature(df, "other", "prompt", None).columns == ["problem", "prompt", "other"]
    assert contracts.dataset_kind(df) == "generic"
    choice = df.withColumn("answer", F.lit("a"))
    assert contracts.dataset_kind(choice) == "multiple_choice"
    rules = choice.selectExpr("*", "1 AS key", "1 AS instruction_id_list", "1 AS kwargs")
    assert contracts.dataset_kind(rules) == "instruction"


def test_pad_text_removed(apply):
    got = apply(lambda a: prompts.without_pad(a, "<pad>"), [("<pad>a<pad><pad>b",), ("c",)])
    assert got == ["ab", "c"]


def test_a_message_without_content_fails(spark):
    df = spark.createDataFrame([("q", None)], "problem string, solution string")
    with pytest.raises(Exception, match="No text in 'content'"):
        prompts.build_sft_text(df).collect()
