import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rolltally.functions import answers

THINK = "</think>"


def texts(*values):
    return [(v,) for v in values]


@pytest.mark.parametrize(
    "text, after_thinking, last_marker, last_open",
    [
        (r"so \boxed{42}.", "42", "42", "42"),
        (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}", r"\frac{1}{2}", r"\frac{1}{2}"),
        (r"\boxed{a{b{c}d}e}f}", "a{b{c}d}e", "a{b{c}d}e", "a{b{c}d}e"),
        (r"\boxed{  x  }", "x", "x", "x"),
        ("\\boxed{\n\u00a0 x\t}", "x", "x", "x"),
        (r"\boxed{}", "", "", ""),
        (r"\boxed{ }", "", "", ""),
        (r"\boxed{1} and \boxed{2}", "1", "2", "2"),
        (r"\boxed{1 and {2}", None, None, None),
        (r"\boxed{1} then \boxed{2", "1", None, None),
        (r"\boxed{1} then \boxed", "1", None, "1"),
        (r"\boxed{1} then \boxed {2}", "1", None, "1"),
        (r"\boxed 3 {4}", None, None, None),
        (r"\boxed{1}" + THINK + r"\boxed{2} \boxed{3}", "2", "3", "3"),
        (r"\boxed{1}" + THINK + "nothing", None, "1", "1"),
        (r"\boxed{1}" + THINK + r"\boxed{2}" + THINK + r"\boxed{3}", "3", "3", "3"),
        (r"\boxed{é{ü}→} end", "é{ü}→", "é{ü}→", "é{ü}→"),
        (r"} { \boxed{5} }", "5", "5", "5"),
        (r"\boxed{\boxed{7}}", r"\boxed{7}", "7", "7"),
        ("no box at all", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_boxed_rules(apply, text, after_thinking, last_marker, last_open):
    assert apply(answers.boxed_after_thinking, [(text,)]) == [after_thinking]
    assert apply(answers.boxed_last_marker, [(text,)]) == [last_marker]
    assert apply(answers.boxed_last_open, [(text,)]) == [last_open]


def closing(text, start):
    """Brute force: characters up to the brace that closes an open one."""
    depth = 1
    for at in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        if depth == 0:
            return text[start:at].strip()
    return None


@given(st.lists(st.sampled_from(["{", "}", r"\boxed{", r"\boxed", "x", " ", THINK]), max_size=14))
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
def test_boxed_rules_against_brute_force(apply, pieces):
    # One Spark job checks all prefixes of a random text.
    cases = ["".join(pieces[:n]) for n in range(len(pieces) + 1)]
    opener = r"\boxed{"

    def first(text):
        shown = text.rsplit(THINK, 1)[-1]
        at = shown.find(opener)
        return None if at < 0 else closing(shown, at + len(opener))

    def last(text, marker):
        at = text.rfind(marker)
        if at < 0 or not text.startswith(opener, at):
            return None
        return closing(text, at + len(opener))

    rows = texts(*cases)
    assert apply(answers.boxed_after_thinking, rows) == [first(t) for t in cases]
    assert apply(answers.boxed_last_marker, rows) == [last(t, r"\boxed") for t in cases]
    assert apply(answers.boxed_last_open, rows) == [last(t, opener) for t in cases]


def test_fallback_answer(apply):
    cases = [
        ("Work.\n**Answer:** 42.", "42"),
        ("**ANSWER:**\n 42 . .", "42"),
        ("Answer: - : 7", "7"),
        ("So the answer: b) is right. Done.", "b) is right. Done"),
        ("The correct answer is: C.", "C"),
        ("Thus, the correct answer is D", "D"),
        ("Answer: 1\nAnswer: 2", "1\nAnswer: 2"),
        ("The correct answer is A. Answer: B", "B"),
        ("Answer: ...", None),
        ("Answer: : - ", None),
        ("one\n\n two \n   \n", "two"),
        ("one\x0btwo\u2028three\x85", "three"),
        ("one\r\ntwo", "two"),
        ("Answer:", None),
        ("first\nAnswer:", None),
        ("**Answer:**", "**"),
        ("**Answer:** a **Answer:** b", "a **Answer:** b"),
        ("think Answer: 1</think>\nplain end.", "plain end."),
        ("Answer: 1</think>", None),
        (" \n\t \n", None),
        ("", None),
        ("ANSWER:  x y  ", "x y"),
        ("a\x1cb\x1dc", "c"),
    ]
    assert apply(answers.fallback_answer, texts(*[c[0] for c in cases])) == [c[1] for c in cases]


def test_last_assistant_and_conversion(spark):
    from pyspark.sql import functions as F

    rows = [
        (0, [("user", "q"), ("assistant", r"\boxed{1}"), ("assistant", r"\boxed{2}")]),
        (1, [("assistant", "Answer: x"), ("user", "more")]),
        (2, [("assistant", "good"), ("assistant", "")]),
        (3, [("user", "q")]),
        (4, []),
        (5, None),
        (6, [("assistant", r"\boxed{} Answer: z")]),
        (7, [("assistant", r"Answer: y \boxed{open")]),
        (8, [("assistant", None)]),
    ]
    df = spark.createDataFrame(rows, "i int, messages array<struct<role: string, content: string>>")
    got = df.select(
        "i",
        answers.last_assistant(F.col("messages")).alias("said"),
        answers.answer_of_messages(F.col("messages")).alias("answer"),
    ).orderBy("i").collect()
    assert [r["said"] for r in got][:6] == [r"\boxed{2}", "Answer: x", None, None, None, None]
    assert [r["answer"] for r in got] == ["2", "x", None, None, None, None, "", r"y \boxed{open", None]


def test_valid_letters(spark):
    from pyspark.sql import functions as F

    rows = [(0, ["a"] * 4), (1, []), (2, None), (3, ["a"] * 30), (4, ["a"])]
    df = spark.createDataFrame(rows, "i int, options array<string>")
    letters = F.array_join(answers.valid_letters(F.col("options")), "")
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    got = [r[0] for r in df.orderBy("i").select(letters).collect()]
    assert got == ["ABCD", alphabet, alphabet, alphabet, "A"]


def test_gold_letter(apply):
    cases = [("b", "B"), ("Option B", "O"), (" (c) ", "C"), ("12", None), ("  ", None), (None, None), ("3D", "D")]
    assert apply(answers.gold_letter, texts(*[c[0] for c in cases])) == [c[1] for c in cases]


@pytest.mark.parametrize(
    "response, letter",
    [
        (r"I say \boxed{ b }", "B"),
        ("<answer> c </answer>", "C"),
        ("Final answer: (D)", "D"),
        ("final answer d.", "D"),
        ("Answer：a", "A"),
        ("Answer: (B) and later Answer: C", "C"),
        ("the correct answer: B", "B"),
        ("correct answer (c)", "C"),
        ("option d it is", "D"),
        ("My choice b!", "B"),
        ("either (A) or (B)", "B"),
        ("it must be c", "C"),
        (r"\boxed{Z} so Answer: B", "B"),
        (r"\boxed{A} \boxed{Z}", "A"),
        ("(E) or (F)", None),
        ("Answer: Apple", None),
        ("nothing here", None),
        ("", None),
        ("   ", None),
        (None, None),
        ("Answer: B " + "x" * 299, None),
        ("Answer: B " + "x " * 140, "B"),
        ("(A) first, later option B", "B"),
        ("Q: A-B-E", "B"),
    ],
)
def test_choice_letter_of_four(spark, response, letter):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(response, ["w", "x", "y", "z"])], "r string, options array<string>")
    got = df.select(answers.choice_letter(F.col("r"), answers.valid_letters(F.col("options")))).first()[0]
    assert got == letter


def test_choice_letter_without_options(apply):
    assert apply(answers.choice_letter, texts("(E) or (F)", "I")) == ["F", "I"]


def test_equality(apply):
    pairs = [("$ X 1$", "x1"), ("a b", "AB"), ("", ""), (" ", "$"), (None, "a"), ("a", None), ("a\tb", "ab")]
    two = "a string, b string"
    assert apply(answers.same_without_dollars, pairs, two) == [True, True, True, True, None, None, False]
    spaced = [("A\t b\n", "ab"), ("", ""), (None, "a"), (" ", None), ("e", "E"), ("a", "b")]
    assert apply(answers.same_without_whitespace, spaced, two) == [True, False, False, False, True, False]


def test_ratio_to_fraction(apply):
    cases = [
        ("3:4", r"\frac{3}{4}"),
        ("-1.5 : 2", r"\frac{-1.5}{2}"),
        (" 1:-2.25\n", r"\frac{1}{-2.25}"),
        ("a:b", "a:b"),
        ("1:2:3", "1:2:3"),
        ("1.:2", "1.:2"),
        ("x 1:2", "x 1:2"),
        (None, None),
    ]
    assert apply(answers.ratio_to_fraction, texts(*[c[0] for c in cases])) == [c[1] for c in cases]


def test_grade(apply):
    cases = [
        ("2", "2", True),
        ("$2$", " 2", True),
        ("2.0", "2", True),
        (r"\frac{4}{2}", "2", True),
        (r"\dfrac{1}{2}", "0.5", True),
        (r"-\frac{1}{2}", "-0.50", True),
        ("1/3", r"\frac{2}{6}", True),
        ("0.333333", "1/3", False),
        ("1/0", "1/0", True),
        ("1/0", "2/0", False),
        ("1/0", "2", False),
        ("X + 1", "x+1", True),
        ("x", "y", False),
        ("", "2", False),
        (None, "2", False),
        ("2", None, False),
        ("0.1234567", "0.1234568", False),
        ("123456789012345678901234567890", "123456789012345678901234567890", True),
        ("999999999999.999999", "999999999999.999998", False),
        ("-0", "0", True),
        ("٣", "3", False),
        ("", "", False),
        ("$ $", "", False),
        (r"\frac{-3}{4}", "-0.75", True),
        (r"\frac{8}{-2}", "-4", True),
        (r"-\frac{-8}{2}", "4", True),
        (".5", "0.5", True),
        ("5.", "5", True),
        ("+5", "5", True),
        ("-5", "5", False),
        ("1,000", "1000", True),
        ("1,00", "100", False),
        ("1,234,567.50", "1234567.5", True),
        ("0.5000000", "0.5", True),
        ("0.12345678", "0.1234567800", True),
        ("1000000000000000", "1000000000000000.0", True),
        ("1000000000000000", "1000000000000001", False),
        ("0" * 50 + "7.0", "7", True),
        ("1/3", "100000000000000000/300000000000000000", True),
        ("1/3", "100000000000000000/300000000000000001", False),
        ("0/5", "-0", True),
    ]
    got = apply(answers.grade, [c[:2] for c in cases], "a string, b string")
    assert got == [c[2] for c in cases]


def test_correctness_reward(apply):
    cases = [
        (r"<think>\boxed{9}</think> \boxed{3:4} \boxed{1}", r"\frac{3}{4}", 1.0),
        (r"\boxed{0.75}", r"\frac{3}{4}", 1.0),
        (r"\boxed{3:4}", "3:4", 1.0),
        (r"\boxed{ e }", "E", 1.0),
        (r"\boxed{}", "", 0.0),
        (r"\boxed{-3:4}", "-0.75", 1.0),
        (r"\boxed{3:-4}", r"-\frac{3}{4}", 1.0),
        ("no box", "1", 0.0),
        (r"\boxed{1}", None, 0.0),
        (None, "1", 0.0),
        (r"\boxed{1}</think> \boxed{2}", "1", 0.0),
    ]
    got = apply(answers.correctness_reward, [c[:2] for c in cases], "a string, b string")
    assert got == [c[2] for c in cases]


def test_shown_answer(apply):
    assert apply(answers.shown_answer, texts("", None, "7")) == ["[No boxed answer found]"] * 2 + ["7"]
