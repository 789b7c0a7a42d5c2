"""Answer extraction and grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.functions import answers
from rolltally.functions.conversation import message
from rolltally.operators.grading import grade_pairs
from rolltally.operators.joins import last_per_key
from rolltally.plans.conversion import extraction_coverage, with_answer

_N = "CAST(doc_id % 97 AS VARCHAR)"


@query(
    "boxed_first_after_thinking",
    rf"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {_N} WHEN 1 THEN 'x_{{' || {_N} || '}}'
                WHEN 2 THEN {_N} WHEN 3 THEN {_N} WHEN 4 THEN '' END AS answer FROM documents""",
)
def boxed_first_after_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = b.boxed_texts(spark, sf_dir)
    return texts.select("doc_id", answers.boxed_after_thinking(F.col("text")).alias("answer"))


@query(
    "boxed_last_marker",
    rf"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '\frac{{' || {_N} || '}}{{2}}'
                WHEN 1 THEN 'x_{{' || {_N} || '}}' WHEN 4 THEN '' END AS answer FROM documents""",
)
def boxed_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = b.boxed_texts(spark, sf_dir)
    return texts.select("doc_id", answers.boxed_last_marker(F.col("text")).alias("answer"))


@query(
    "boxed_last_open",
    rf"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '\frac{{' || {_N} || '}}{{2}}'
                WHEN 1 THEN 'x_{{' || {_N} || '}}' WHEN 2 THEN {_N} WHEN 4 THEN '' END AS answer
         FROM documents""",
)
def boxed_last_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = b.boxed_texts(spark, sf_dir)
    return texts.select("doc_id", answers.boxed_last_open(F.col("text")).alias("answer"))


@query(
    "fallback_answer",
    r"""SELECT doc_id,
               CASE WHEN doc_id % 7 IN (0, 1, 2) THEN CAST(doc_id % 89 AS VARCHAR)
                    WHEN doc_id % 7 = 4 THEN 'last line ' || CAST(doc_id % 89 AS VARCHAR)
                    WHEN doc_id % 7 = 6 THEN regexp_replace(
                      rtrim(text, chr(32) || chr(9) || chr(10) || chr(13)), '^(?s:.*)[\n\r]\s*', '')
               END AS answer
        FROM documents""",
)
def fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = b.cued_texts(spark, sf_dir)
    return texts.select("doc_id", answers.fallback_answer(F.col("text")).alias("answer"))


@query(
    "last_assistant_message",
    """SELECT conv_id, max_by(text, turn) FILTER (role = 'assistant') AS said
       FROM conversations GROUP BY conv_id""",
)
def last_assistant_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a table of turns a partial aggregate finds the message; no conversation is
    gathered."""
    turns = b.table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "assistant", F.col("turn"))
    return turns.groupBy("conv_id").agg(F.max_by("text", said).alias("said"))


@query(
    "last_assistant_of_messages",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, CASE WHEN tell_role = 'assistant' THEN solution
                                   WHEN ask_role = 'assistant' THEN problem END AS said FROM pairs""",
)
def last_assistant_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_messages(spark, sf_dir).select(
        "conv_id", "turn", answers.last_assistant(F.col("messages")).alias("said")
    )


def _pair_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array(
        F.struct(F.col("ask_role").alias("role"), F.col("problem").alias("content")),
        F.struct(F.col("tell_role").alias("role"), F.col("solution").alias("content")),
    )
    return b.turn_pairs(spark, sf_dir).select("conv_id", "turn", messages.alias("messages"))


# Every message text of the pairs ends in a period; conversations hold no cue phrase.
_CONVERTED = f"""WITH {b.TURN_PAIRS},
said AS (
  SELECT conv_id, turn, CASE WHEN tell_role = 'assistant' THEN solution
                             WHEN ask_role = 'assistant' THEN problem END AS text FROM pairs
),
converted AS (
  SELECT conv_id, turn,
         regexp_replace(rtrim(text, chr(32) || chr(9) || chr(10) || chr(13)), '^(?s:.*)[\\n\\r]\\s*', '') AS answer
  FROM said
)"""


@query("answer_conversion", _CONVERTED + " SELECT conv_id, turn, answer FROM converted")
def answer_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_answer(_pair_messages(spark, sf_dir)).drop("messages")


@query(
    "answer_conversion_boxed",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn,
               CASE WHEN turn % 2 = 0 THEN '{{' || CAST(conv_id AS VARCHAR) || '}}'
                    ELSE 'option ' || CAST(conv_id AS VARCHAR) END AS answer
        FROM pairs""",
)
def answer_conversion_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions that end in a box, or in a cue phrase with the box left open."""
    conv = F.col("conv_id").cast("string")
    boxed = F.concat("solution", F.lit(" \\boxed{{"), conv, F.lit("}}"))
    cued = F.concat(F.lit("\\boxed{ "), "solution", F.lit("\nANSWER: option "), conv, F.lit("."))
    solution = F.when(F.pmod("turn", F.lit(2)) == 0, boxed).otherwise(cued)
    pairs = b.turn_pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.array(message("user", F.col("problem")), message("assistant", solution)).alias("messages"),
    )
    return with_answer(pairs).drop("messages")


@query(
    "extraction_coverage",
    _CONVERTED
    + """ SELECT count(*) AS total_rows, count(answer) AS extracted_rows,
                 count(*) - count(answer) AS missing_rows FROM converted""",
)
def extraction_coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_coverage(with_answer(_pair_messages(spark, sf_dir)))


@query(
    "valid_choice_letters",
    """SELECT p_partkey, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(least(p_size, 26) AS INTEGER)) AS letters
       FROM part""",
)
def valid_choice_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array_repeat(F.col("p_name"), F.col("p_size"))
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(answers.valid_letters(options), "").alias("letters")
    )


@query(
    "gold_choice_letter",
    """SELECT o_orderkey, nullif(regexp_extract(upper(o_orderpriority), '[A-Z]'), '') AS priority_letter,
              substr('ABCD', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS gold_answer
       FROM orders""",
)
def gold_choice_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", answers.gold_letter(F.col("o_orderpriority")).alias("priority_letter")
    )
    gold = b.choice_examples(spark, sf_dir).select(
        F.col("row_index").alias("o_orderkey"), answers.gold_letter(F.col("answer")).alias("gold_answer")
    )
    return orders.join(gold, "o_orderkey")


@query(
    "choice_extraction",
    f"WITH {b.CHOICES} SELECT row_index, predicted_answer FROM scored WHERE NOT missing",
)
def choice_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = b.choice_examples(spark, sf_dir).select("row_index", "options")
    last = last_per_key(b.choice_responses(spark, sf_dir), ["row_index"], "arrival")
    letter = answers.choice_letter(F.col("response"), answers.valid_letters(F.col("options")))
    return examples.join(last, "row_index").select("row_index", letter.alias("predicted_answer"))


@query(
    "answer_equality",
    r"""SELECT o_orderkey, lower(left_text) = lower(right_text) AS same_without_dollars,
               lower(left_text) = lower(right_text) AS same_without_whitespace,
               a = c AS same_number
        FROM (SELECT o_orderkey, o_custkey % 7 AS a, o_orderkey % 7 AS c,
                     CASE WHEN o_custkey % 2 = 0 THEN 'X' || CAST(o_custkey % 7 AS VARCHAR)
                          ELSE CAST(o_custkey % 7 AS VARCHAR) END AS left_text,
                     CASE WHEN o_orderkey % 2 = 0 THEN 'x' || CAST(o_orderkey % 7 AS VARCHAR)
                          ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS right_text
              FROM orders)""",
)
def answer_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.pmod("o_custkey", F.lit(7)), F.pmod("o_orderkey", F.lit(7))
    left = F.concat(
        F.lit(" $ "), F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.lit("X ")).otherwise(F.lit("")), a, F.lit("$")
    )
    right = F.concat(F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit("x")).otherwise(F.lit("")), c, F.lit(" "))
    half = F.concat(F.lit("$\\dfrac{"), (c * 3).cast("string"), F.lit("}{6}$"))
    tenths = F.concat((a * 5).cast("string"), F.lit("/10.0"))
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        answers.same_without_dollars(left, right).alias("same_without_dollars"),
        answers.same_without_whitespace(F.translate(left, "$", " \t"), right).alias("same_without_whitespace"),
        answers.same_number(tenths, half).alias("same_number"),
    )


@query(
    "ratio_to_fraction",
    r"""SELECT CASE WHEN l_returnflag = 'N' THEN 'a:b' WHEN l_returnflag IS NOT NULL THEN
                 '\frac{-' || CAST(l_linenumber AS VARCHAR) || '.5}{' || CAST(l_suppkey AS VARCHAR) || '}' END
               AS rewritten, count(*) AS n
        FROM lineitem GROUP BY ALL""",
)
def ratio_to_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.concat(
        F.lit(" -"), F.col("l_linenumber").cast("string"), F.lit(".5 :\t"), F.col("l_suppkey").cast("string"), F.lit(" ")
    )
    answer = F.when(F.col("l_returnflag") == "N", F.lit("a:b")).when(F.col("l_returnflag").isNotNull(), ratio)
    return (
        b.table(spark, sf_dir, "lineitem")
        .groupBy(answers.ratio_to_fraction(answer).alias("rewritten"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "correctness_reward",
    """SELECT event_id, CASE WHEN event_type <> 'error' AND user_id % 5 = event_id % 5 THEN 1.0::DOUBLE
                             ELSE 0.0::DOUBLE END AS reward FROM events""",
)
def correctness_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as ratios, numbers or letters, first box after the thinking counts."""
    given, gold = F.pmod("user_id", F.lit(5)), F.pmod("event_id", F.lit(5))
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", F.concat(given.cast("string"), F.lit(" : 4")))
        .when(kind == "view", F.concat(given.cast("string"), F.lit(".50")))
        .otherwise(F.substring(F.lit("ABCDE"), (given + 1).cast("int"), F.lit(1)))
    )
    wanted = (
        F.when(kind == "click", F.concat(F.lit("\\frac{"), (gold * 3).cast("string"), F.lit("}{12}")))
        .when(kind == "view", F.concat(F.lit("\\frac{"), (gold * 2 + 1).cast("string"), F.lit("}{2}")))
        .otherwise(F.substring(F.lit("a b c d e "), (gold * 2 + 1).cast("int"), F.lit(2)))
    )
    completion = F.when(
        kind != "error",
        F.concat(F.lit("<think>\\boxed{none}</think>"), "props", F.lit(" \\boxed{"), answer, F.lit("} not \\boxed{0}")),
    ).otherwise(F.col("props"))
    return b.table(spark, sf_dir, "events").select(
        "event_id", answers.correctness_reward(completion, wanted, expressions=False).alias("reward")
    )


_A, _B, _C = "(o_custkey % 9 + 1)", "(o_orderkey % 7 + 1)", "(o_custkey // 9 % 3)"


@query(
    "expression_equality",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 3 THEN {_A} = {_B} WHEN o_orderkey % 11 = 10 THEN false
                                ELSE {_C} = 0 END AS equal FROM orders""",
)
def expression_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written in two ways; the second is off by a number, which may be zero."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first, second, off = F.pmod("o_custkey", F.lit(9)) + 1, F.pmod("o_orderkey", F.lit(7)) + 1, F.pmod(F.floor(F.col("o_custkey") / 9), F.lit(3))
    pairs = [
        (r"\frac{%1$s}{%2$s}", r"(%1$s+%3$s)/%2$s"),
        (r"%1$s\%%", r"\frac{%1$s + %3$s}{100}"),
        (r"\sqrt{%1$s^2 \cdot %2$s}", r"(%1$s+%3$s)\sqrt{%2$s}"),
        ("(%1$s, %2$s)", r"\left( %2$s , %1$s \right)"),
        (r"\{%1$s, %2$s\}", r"\{ %2$s, %1$s+%3$s \}"),
        ("x^2 - %1$s^2", "(x - %1$s)(x + %1$s + %3$s)"),
        (r"%1$s\text{ cm}", "x = %1$s + %3$s"),
        ("2^{%2$s}", "2^%2$s + %3$s"),
        (r"\frac{1}{\sqrt{%2$s+1}+\sqrt{%2$s}}", r"\sqrt{%2$s+1} - \sqrt{%2$s} - %3$s"),
        (r"%1$s\pi + %2$s\pi", r"(%1$s + %2$s + %3$s)\pi"),
        (r"\frac{%1$s", r"%1$s/"),
    ]
    which = F.pmod("o_orderkey", F.lit(len(pairs))).cast("int")
    numbers = [x.cast("string") for x in (first, second, off)]
    left, right = (F.coalesce(*[F.when(which == i, F.format_string(pair[k], *numbers)) for i, pair in enumerate(pairs)]) for k in (0, 1))
    answered = orders.select("o_orderkey", left.alias("left"), right.alias("right"))
    return grade_pairs(answered, "left", "right", "equal").select("o_orderkey", "equal")
