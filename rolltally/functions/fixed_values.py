"""Texts, patterns and constants that results depend on literally."""

# --- Prompt texts -----------------------------------------------------------------

STEP_BY_STEP = "Please reason step by step, and put your final answer within \\boxed{}."

REFERENCE_SOLUTION_LEAD = "Here is a reference solution to this problem:\n"
REFERENCE_SOLUTION_BEGIN = "=== Reference Solution Begin ===\n"
REFERENCE_SOLUTION_END = "\n=== Reference Solution End ===\n"

REFERENCE_REASONING_LEAD = "Here is a correct reasoning to this problem:"
REFERENCE_REASONING_START = "=== Reference Reasoning Start ===\n"
REFERENCE_REASONING_END = "\n=== Reference Reasoning End ===\n\n"

REASON_FIRST = (
    "\n\nThe reference reasoning above arrives at the correct answer. "
    "Please analyze this solution and explain the key reasoning steps and problem-solving strategies employed. "
    "Do NOT use <think> tags. Do NOT derive your own solution. "
    "Simply analyze and explain the reference solution provided above.\n"
)

TRANSITION = (
    "\n\nAfter reading the reference solution above, make sure you truly understand "
    "the reasoning behind each step — do not copy or paraphrase it. Now, using your "
    "own words and independent reasoning, derive the same final answer to the problem above. "
    "Think step by step, explore different approaches, and don't be afraid to backtrack "
    "or reconsider if something doesn't work out:\n"
)

REFERENCE_ANSWER_INTRO = (
    "\n\nBelow is a high-quality reference answer to the same request. "
    "Use it as guidance, but write your own answer to the original request rather than copying it verbatim. "
    "Make sure your final answer follows all constraints in the original prompt.\n\nReference answer:\n"
)

REFERENCE_ANSWER_OUTRO = (
    "\n\nNow provide your own final answer to the original request. "
    "Do not mention the reference answer."
)

# --- Dataset formats and column contracts -----------------------------------------

MATH_FORMAT = "math"
INSTRUCTION_FORMATS = ("instruction", "prompt_teacher_prompt", "teacher_prompt")

INSTRUCTION_EVAL_COLUMNS = ("key", "prompt", "instruction_id_list", "kwargs")
MULTIPLE_CHOICE_COLUMNS = ("prompt", "answer")

SIGNATURE_COLUMNS = (
    "problem",
    "solution",
    "prompt",
    "teacher_prompt",
    "gpt4_response",
    "messages",
    "completion",
)

# Order in which the files of a dataset folder are looked for.
SPLIT_FILE_FORMATS = (("jsonl", "json"), ("json", "json"), ("parquet", "parquet"), ("csv", "csv"))

# --- Answer extraction --------------------------------------------------------------

BOXED = "\\boxed"
THINK_END = "</think>"
NO_ANSWER = "[No boxed answer found]"

# Characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Tried in this order, ignoring case, over the whole text.
ANSWER_PATTERNS = (
    r"\*\*Answer:\*\*\s*(.+?)\s*$",
    r"Answer:\s*(.+?)\s*$",
    r"The correct answer is\s*(.+?)\s*$",
    r"Thus, the correct answer is\s*(.+?)\s*$",
)

# Taken off the start of a last line that serves as the answer.
ANSWER_LINE_PREFIXES = (r"^\*\*Answer:\*\*\s*", r"^Answer:\s*")

# Two decimals with a colon between them, and white space around.
DECIMAL_TEXT = r"-?\d+(?:\.\d+)?"
BLANK_TEXT = r"[\s\x1c-\x1f]*"
RATIO_TEXT = rf"(?U)^{BLANK_TEXT}({DECIMAL_TEXT}){BLANK_TEXT}:{BLANK_TEXT}({DECIMAL_TEXT}){BLANK_TEXT}\z"

# Plain numbers, with or without thousands separators, and their fractions.
NUMBER_TEXT = r"(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)"
FRACTION_TEXT = rf"^([+-]?)\\[dt]?frac\{{([+-]?{NUMBER_TEXT})\}}\{{([+-]?{NUMBER_TEXT})\}}\z"
QUOTIENT_TEXT = rf"^[+-]{{0,2}}{NUMBER_TEXT}(?:/[+-]?{NUMBER_TEXT})?\z"

# Tried in this order on the upper-cased end of a response.
CHOICE_PATTERNS = (
    r"\\BOXED\{\s*([A-Z])\s*\}",
    r"<ANSWER>\s*([A-Z])\s*</ANSWER>",
    r"FINAL ANSWER\s*[:：]?\s*\(?([A-Z])\)?\b",
    r"ANSWER\s*[:：]\s*\(?([A-Z])\)?\b",
    r"CORRECT ANSWER\s*[:：]?\s*\(?([A-Z])\)?\b",
    r"OPTION\s*([A-Z])\b",
    r"CHOICE\s*([A-Z])\b",
    r"\(([A-Z])\)",
)
CHOICE_TAIL = 300
CHOICE_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# --- Training-data shapes -----------------------------------------------------------

IGNORED_LABEL = -100
MIN_PROBABILITY = 1e-8
SAVE_EVERY = 5
SEED = 42
SFT_TEST_FRACTION = 0.01
RL_TEST_FRACTION = 0.007
LOGGED_PROMPTS = 8
