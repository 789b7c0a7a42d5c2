"""Answer extraction and grading, as native expressions.

The three boxed-answer rules differ on purpose:

========================  =====================================  =====================
function                  looks at                               trailing bare marker
========================  =====================================  =====================
``boxed_after_thinking``  first box after the last ``</think>``  ignored
``boxed_last_marker``     last ``\\boxed``, braces or not        hides earlier boxes
``boxed_last_open``       last ``\\boxed{``                      ignored
========================  =====================================  =====================

An unclosed box gives null, an empty one gives ``""``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.expressions import same_expression
from rolltally.functions.fixed_values import (
    ANSWER_LINE_PREFIXES,
    ANSWER_PATTERNS,
    BOXED,
    CHOICE_LETTERS,
    CHOICE_PATTERNS,
    CHOICE_TAIL,
    FRACTION_TEXT,
    LINE_BREAKS,
    NO_ANSWER,
    QUOTIENT_TEXT,
    RATIO_TEXT,
    THINK_END,
    WHITESPACE,
)
from rolltally.functions.text import (
    after_last,
    from_position,
    let,
    null_if_empty,
    strip,
    without_whitespace,
)

BOX_OPEN = BOXED + "{"


# --- Boxed answers ------------------------------------------------------------------


def _until_closing_brace(tail: Column) -> Column:
    """Trimmed text before the ``}`` that closes a brace opened just before ``tail``."""

    def close(tail: Column) -> Column:
        first = F.substring_index(tail, "}", 1)
        nested = F.contains(first, F.lit("{"))
        return F.when(
            F.contains(tail, F.lit("}")),
            F.when(nested, _until_balanced(tail)).otherwise(strip(first)),
        )

    return let(tail, close)


def _until_balanced(tail: Column) -> Column:
    """As above where braces are nested.

    Only braces decide, so the text is cut at ``}`` and the fold runs over the pieces,
    counting the ``{`` inside each, instead of over single characters.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used"), F.lit(-1).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        size = F.length(piece)
        opened = size - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = state["depth"] + opened - 1
        stop = state["used"] + size
        advanced = F.struct(
            depth.alias("depth"),
            (stop + 1).alias("used"),
            F.when(depth == 0, stop).otherwise(F.lit(-1)).alias("end"),
        )
        return F.when(state["end"] >= 0, state).otherwise(advanced)

    # The piece behind the last "}" is not followed by a closing brace.
    closed = let(F.split(tail, r"\}"), lambda pieces: F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    end = F.aggregate(closed, start, step, lambda state: state["end"])
    return let(end, lambda end: F.when(end >= 0, strip(F.substring(tail, F.lit(1), end))))


def boxed_after_thinking(text: Column) -> Column:
    """First boxed answer after the last ``</think>`` (whole text without one)."""

    def first_box(shown: Column) -> Column:
        inside = from_position(shown, F.instr(shown, BOX_OPEN) + len(BOX_OPEN))
        return F.when(F.contains(shown, F.lit(BOX_OPEN)), _until_closing_brace(inside))

    return F.when(F.contains(text, F.lit(BOX_OPEN)), let(after_last(text, THINK_END), first_box))


def boxed_last_marker(text: Column) -> Column:
    """Boxed answer at the last ``\\boxed``; null if no brace follows it directly."""
    tail = after_last(text, BOXED)
    usable = F.contains(text, F.lit(BOXED)) & F.startswith(tail, F.lit("{"))
    return F.when(usable, _until_closing_brace(from_position(tail, F.lit(2))))


def boxed_last_open(text: Column) -> Column:
    """Boxed answer at the last ``\\boxed{``."""
    return F.when(
        F.contains(text, F.lit(BOX_OPEN)), _until_closing_brace(after_last(text, BOX_OPEN))
    )


# --- Answers without a box ----------------------------------------------------------

_IGNORE_CASE = "(?isuU)"
_ANY_CUE = "(?iu)answer(:| is)"


def fallback_answer(text: Column) -> Column:
    """Answer of a text without a usable box: after a cue phrase, else the last line."""

    def pick(body: Column) -> Column:
        cued = F.coalesce(
            *[null_if_empty(F.regexp_extract(body, _IGNORE_CASE + p, 1)) for p in ANSWER_PATTERNS]
        )

        def clean(cued: Column) -> Column:
            led = F.ltrim(strip(cued), F.lit(WHITESPACE + ":.-"))
            return null_if_empty(F.rtrim(led, F.lit(WHITESPACE + ".")))

        # One scan tells whether any cue occurs; most texts skip the patterns.
        has_cue = F.regexp_like(body, F.lit(_ANY_CUE))
        line = _last_line(body)
        return F.when(
            has_cue,
            let(cued, lambda c: F.when(c.isNotNull(), clean(c)).otherwise(_without_cue(line))),
        ).otherwise(null_if_empty(line))

    return let(strip(after_last(text, THINK_END)), pick)


def _last_line(body: Column) -> Column:
    """Last line of a text without white space at its end."""
    # What remains behind each kind of break in turn lies behind the last break of any kind.
    # All but the first search run over a short rest.
    line = body
    for line_break in LINE_BREAKS:
        line = after_last(line, line_break)
    return strip(line)


def _without_cue(line: Column) -> Column:
    for prefix in ANSWER_LINE_PREFIXES:
        line = F.regexp_replace(line, "(?iuU)" + prefix, "")
    return null_if_empty(line)


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant message; null when there is none or it is empty."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return null_if_empty(F.try_element_at(said, F.lit(-1))["content"])


def answer_of_text(text: Column) -> Column:
    """Boxed answer, else the fallback answer; null for empty text."""
    said = null_if_empty(text)
    return F.when(said.isNotNull(), F.coalesce(boxed_last_open(said), fallback_answer(said)))


def answer_of_messages(messages: Column) -> Column:
    """Answer given in the last assistant message of a conversation."""
    return let(last_assistant(messages), answer_of_text)


# --- Multiple choice ----------------------------------------------------------------


def valid_letters(options: Column | None = None) -> Column:
    """Letters that may be chosen: one per option, all of them without options."""
    letters = F.split(F.lit(" ".join(CHOICE_LETTERS)), " ")
    if options is None:
        return letters
    count = F.least(F.size(options), F.lit(len(CHOICE_LETTERS)))
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.slice(letters, F.lit(1), count)).otherwise(
        letters
    )


def gold_letter(answer: Column) -> Column:
    """First capital letter of the upper-cased gold answer."""
    return null_if_empty(F.regexp_extract(F.upper(strip(answer.cast("string"))), "[A-Z]", 0))


# Plain text without which the pattern of the same rank cannot match. Looking for it first
# costs little and spares most rows most of the patterns.
_CHOICE_CUES = ("\\BOXED{", "<ANSWER>", "FINAL ANSWER", "ANSWER", "CORRECT ANSWER", "OPTION", "CHOICE", "(")


def choice_letter(response: Column, valid: Column | None = None) -> Column:
    """Letter chosen in a response, or null.

    The first pattern with a valid match decides, and of its matches the last valid one.
    Without any, the last letter standing alone counts.
    """
    allowed = valid_letters() if valid is None else valid

    def last_valid(found: Column, allowed: Column) -> Column:
        return F.try_element_at(
            F.filter(found, lambda x: F.array_contains(allowed, x)), F.lit(-1)
        )

    def pick(tail: Column, allowed: Column) -> Column:
        named = [
            F.when(
                F.contains(tail, F.lit(cue)),
                last_valid(F.regexp_extract_all(tail, F.lit("(?U)" + p), F.lit(1)), allowed),
            )
            for cue, p in zip(_CHOICE_CUES, CHOICE_PATTERNS)
        ]
        # Runs of capital letters of length one.
        alone = F.filter(F.split(tail, "[^A-Z]+"), lambda run: F.length(run) == 1)
        return F.coalesce(*named, last_valid(alone, allowed))

    tail = F.right(F.upper(strip(response)), F.lit(CHOICE_TAIL))
    return let(tail, lambda t: let(allowed, lambda a: pick(t, a)))


# --- Equality and grades ------------------------------------------------------------


def _bare(text: Column) -> Column:
    """Text without ``$``, blanks and white space around it."""
    for removed in ("$", " "):
        text = F.replace(text, F.lit(removed), F.lit(""))
    return strip(text)


def same_without_dollars(left: Column, right: Column) -> Column:
    """Equality after removing ``$`` and blanks and lower-casing."""
    return (left == right) | (_bare(F.lower(left)) == _bare(F.lower(right)))


def same_without_whitespace(left: Column, right: Column) -> Column:
    """Equality after removing white space and lower-casing; never true for empty text."""

    def plain(x: Column) -> Column:
        return F.lower(without_whitespace(F.coalesce(x, F.lit(""))))

    return let(plain(left), lambda a: (a != "") & (a == plain(right)))


def ratio_to_fraction(answer: Column) -> Column:
    """Rewrite ``a:b`` of two decimals as ``\\frac{a}{b}``; leave everything else."""
    rewritten = F.regexp_replace(answer, RATIO_TEXT, r"\\frac{$1}{$2}")
    return F.when(F.contains(answer, F.lit(":")), rewritten).otherwise(answer)


def _digits(number: Column) -> Column:
    """Digits of an unsigned plain number without its point."""
    return F.replace(number, F.lit("."), F.lit(""))


def _decimals(number: Column) -> Column:
    """How many digits stand behind the point."""
    return F.when(F.contains(number, F.lit(".")), F.length(F.substring_index(number, ".", -1))).otherwise(F.lit(0))


def _canonical(number: Column) -> Column:
    """Unsigned number without zeros that mean nothing; zero is the empty text."""
    short = F.when(
        F.contains(number, F.lit(".")), F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))
    ).otherwise(number)
    return F.ltrim(short, F.lit("0"))


def _same_product(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a * b equals c * d, for unsigned plain numbers.

    Digits are multiplied as whole numbers of up to 38 digits and aligned as text; null if
    a product is longer.
    """

    def product(x: Column, y: Column, more: Column) -> Column:
        value = F.try_multiply(_digits(x).try_cast("decimal(38,0)"), _digits(y).try_cast("decimal(38,0)"))
        zeros = F.repeat(F.lit("0"), F.greatest(more, F.lit(0)))
        return F.ltrim(F.concat(value.cast("string"), zeros), F.lit("0"))

    behind = (_decimals(c) + _decimals(d)) - (_decimals(a) + _decimals(b))
    return product(a, b, behind) == product(c, d, -behind)


def _same_value(left: Column, right: Column) -> Column:
    """Whether two bare texts are numbers or fractions of equal value; null if not both
    are numbers.

    Signs may stand before a fraction and in both of its parts. Numbers of any length are
    compared digit by digit, fractions by cross products.
    """

    def spelled(bare: Column) -> Column:
        fraction = F.regexp_replace(bare, FRACTION_TEXT, "$1$2/$3")
        return F.when(F.contains(bare, F.lit("frac{")), fraction).otherwise(bare)

    def unsigned(quotient: Column) -> Column:
        return F.translate(quotient, "+-,", "")

    def negative(quotient: Column) -> Column:
        signs = F.length(quotient) - F.length(F.replace(quotient, F.lit("-"), F.lit("")))
        return F.pmod(signs, F.lit(2)) == 1

    def compared(a: Column, b: Column) -> Column:
        above_a, above_b = F.substring_index(unsigned(a), "/", 1), F.substring_index(unsigned(b), "/", 1)
        one = F.lit("1")
        below_a = F.when(F.contains(a, F.lit("/")), F.substring_index(unsigned(a), "/", -1)).otherwise(one)
        below_b = F.when(F.contains(b, F.lit("/")), F.substring_index(unsigned(b), "/", -1)).otherwise(one)
        same_parts = (_canonical(above_a) == _canonical(above_b)) & (_canonical(below_a) == _canonical(below_b))
        both_whole = ~F.contains(a, F.lit("/")) & ~F.contains(b, F.lit("/"))
        same_size = F.when(both_whole | same_parts, same_parts).otherwise(
            F.coalesce(_same_product(above_a, below_b, above_b, below_a), F.lit(False))
        )
        defined = (_canonical(below_a) != "") & (_canonical(below_b) != "")
        same_sign = (negative(a) == negative(b)) | (_canonical(above_a) == "")
        return defined & same_size & same_sign

    def both_numbers(a: Column, b: Column) -> Column:
        return F.regexp_like(a, F.lit(QUOTIENT_TEXT)) & F.regexp_like(b, F.lit(QUOTIENT_TEXT))

    return let(
        spelled(left),
        lambda a: let(spelled(right), lambda b: F.when(both_numbers(a, b), compared(a, b))),
    )


def same_number(left: Column, right: Column) -> Column:
    """True where both sides are plain numbers or fractions of equal value."""
    return F.coalesce(_same_value(_bare(left), _bare(right)), F.lit(False))


def _same_in_value(left: Column, right: Column, bare_left: Column, bare_right: Column, expressions: bool) -> Column:
    other = same_expression(left, right) if expressions else F.lit(False)
    return F.coalesce(_same_value(bare_left, bare_right), other)


def grade(predicted: Column, gold: Column, expressions: bool = True) -> Column:
    """Whether a predicted answer equals the gold one; false for a missing prediction.

    Equal as text without ``$``, blanks and case, or equal in value: as numbers, or else as
    expressions. Nothing equals an empty answer, not even an empty gold one. Where answers
    are plain numbers, ``expressions=False`` saves planning what is never computed.
    """

    def compare(p: Column, g: Column) -> Column:
        def bare(a: Column, b: Column) -> Column:
            same_text = (F.lower(a) == F.lower(b)) & (a != "")
            return F.when(same_text, F.lit(True)).otherwise(_same_in_value(p, g, a, b, expressions))

        return let(_bare(p), lambda a: let(_bare(g), lambda b: bare(a, b)))

    given = predicted.isNotNull() & gold.isNotNull()
    unequal = let(predicted, lambda p: let(gold, lambda g: compare(p, g)))
    return F.when((predicted == gold) & (_bare(gold) != ""), F.lit(True)).when(given, unequal).otherwise(F.lit(False))


def correctness_reward(completion: Column, gold: Column, expressions: bool = True) -> Column:
    """1.0 for a completion whose boxed answer is right, else 0.0."""

    def right(predicted: Column) -> Column:
        def in_value(p: Column) -> Column:
            return _same_in_value(p, gold, _bare(p), _bare(gold), expressions)

        same_text = same_without_whitespace(predicted, gold)
        return F.when(same_text, F.lit(True)).otherwise(let(ratio_to_fraction(predicted), in_value))

    return let(
        boxed_after_thinking(completion),
        lambda predicted: F.when(predicted.isNotNull() & gold.isNotNull() & right(predicted), F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def shown_answer(predicted: Column) -> Column:
    """Answer as reported: null and empty predictions become the placeholder."""
    return F.coalesce(null_if_empty(predicted), F.lit(NO_ANSWER))


