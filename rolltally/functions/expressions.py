"""Equality of mathematical expressions in LaTeX, as column functions.

An answer is cut into tokens by one pattern. A fold over the tokens with a stack of pending
operators brings them into postfix order, a second fold with a stack of values computes them,
and two answers are equal if they come to the same values: identity testing at random
points. Values are taken modulo a prime, where every letter stands for a fixed random
square and every function of an argument for a fixed random value of that argument; a
second set of points confirms. No part of this runs in Python.

The prime is chosen so that roots behave as they do among positive numbers: it is twice a
prime plus one, so that every square has exactly one square as its n-th root for any n, and
small primes are squares, so that the root of a square is the number itself, roots multiply,
and their powers give back what is under them. Numbers with a larger prime factor under an
even root have no root here in half of the cases and are then compared as text only.

Understood are numbers, letters, words of three or more letters as names, ``+ - * / ^``,
products without a sign, fractions, mixed numbers, roots, powers with rational exponents,
factorials, percent, functions, brackets, lists, tuples, intervals and sets; units in text
wrappers, degrees, money signs, thousands separators and a leading ``x =`` are taken off.
What is not understood has no value (null) and equals nothing.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.text import let, strip

# --- Fixed values ---------------------------------------------------------------------

# Twice a prime plus one, 7 modulo 8; all primes to 67 are squares modulo it.
PRIME = 1_931_011_319
HALF = (PRIME - 1) // 2
MOST_ROOT = 24
MOST_FACTORIAL = 20
SEEDS = [11, 29]

# What is rewritten before tokens are cut, in this order.
REWRITES = [
    (r"\\(?:left|right|displaystyle|big|Big|limits)(?![A-Za-z])", ""),
    (r"\\[,;:! ]|~|\\q?quad(?![A-Za-z])|\\\$|\$|\\[()]", " "),
    (r"\\[dtc]frac", r"\\frac"),
    (r"(?:\^\s*\{?\s*\\circ\s*\}?|\\degree(?![A-Za-z])|°)", ""),
    # A wrapper behind a digit, bracket or blank holds a unit, else it is the answer.
    (r"(?<=[0-9\}\)\]])\s*\\(?:text|mathrm|textbf|mbox|operatorname)\s*\{[^{}]*\}(?:\s*\^\s*\{?\s*-?\d\s*\}?)?", ""),
    (r"\\(?:text|mathrm|textbf|mathbf|mbox|boldsymbol|operatorname|textrm|textit)\s*\{([^{}]*)\}", "$1"),
    (r"(?<=\d)\{,\}(?=\d{3})", ""),
    (r"\\%", "%"),
    (r"\\(?:cdot|times|ast)(?![A-Za-z])|·|×", "*"),
    (r"\\div(?![A-Za-z])|÷", "/"),
    (r"−|–", "-"),
    (r"π", r"\\pi "),
    (r"√", r"\\sqrt"),
    (r"∞", r"\\infty "),
    (r"\\frac\s*(\d)\s*(\d)", r"\\frac{$1}{$2}"),
    (r"\\frac\s*(\d)\s*\{", r"\\frac{$1}{"),
    (r"(\\frac\s*\{[^{}]*\})\s*([0-9A-Za-z])", "$1{$2}"),
    (r"(?<![\d.])(\d+)\s*\\frac\s*\{\s*(\d+)\s*\}\s*\{\s*(\d+)\s*\}", r"($1+\\frac{$2}{$3})"),
    (r"(?:^|(?<=,))\s*(?:[A-Za-z]|\\[a-z]+)(?:_\{?\w+\}?)?(?:\([a-z]\))?\s*=(?!=)", ""),
]
THOUSANDS = r"(?<=(?:^|[^\d.])\d{1,3}(?:,\d{3}){0,12}),(?=\d{3}(?!\d))"
TOKEN = (
    r"\d+(?:\.\d+)?|\.\d+|\}\s*\{|\\sqrt\s*\[\s*\d+\s*\]|\\log_(?:\{\w+\}|\w)|\\\{|\\\}|\\[A-Za-z]+"
    r"|[A-Za-z]{3,}|[A-Za-z](?:_(?:\{\w+\}|\w))?|[^\s]"
)
FUNCTIONS = ["\\sin", "\\cos", "\\tan", "\\cot", "\\sec", "\\csc", "\\arcsin", "\\arccos", "\\arctan", "\\ln", "\\log", "\\exp"]
# Commands that are names; others, such as relations, are not understood.
NAMES = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega infty emptyset varnothing ell"
).split()
# Kinds of tokens: operators with how strongly they bind, brackets, prefixes. A closing and an
# opening brace side by side part the halves of a fraction.
OPERATORS = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 5}
NEGATION, FUNCTION, ROOT = 3, 4, 6
KINDS = (
    {op: "o" for op in OPERATORS}
    | {op: "(" for op in ("(", "{", "[", "\\{")}
    | {op: ")" for op in (")", "}", "]", "\\}")}
    | {op: "f" for op in FUNCTIONS}
    | {"\\" + name: "s" for name in NAMES}
    | {"\\frac": "q", "}{": "h", ",": ",", "!": "!", "%": "!"}
)
BEGINS, ENDS = "nsf(q", "ns)!"


# --- Arithmetic modulo the prime ------------------------------------------------------


def _constant(values: list | dict) -> Column:
    """An array or map of literals, parsed at once."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}L"
    if isinstance(values, dict):
        return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in values.items()) + ")")
    return F.expr("array(" + ", ".join(map(text, values)) + ")")


def _times(a: Column, b: Column) -> Column:
    return (a * b) % F.lit(PRIME)


def _power(base: Column, exponent: Column) -> Column:
    """``base`` to an exponent of up to 31 bits, by squaring."""

    def step(state: Column, bit: Column) -> Column:
        done = F.when(F.getbit(exponent, bit) == 1, _times(state["done"], state["base"])).otherwise(state["done"])
        return F.struct(done.alias("done"), _times(state["base"], state["base"]).alias("base"))

    bits = F.sequence(F.lit(0), F.greatest(F.length(F.bin(exponent)) - 1, F.lit(0)))
    start = F.struct(F.lit(1).cast("long").alias("done"), base.alias("base"))
    return F.aggregate(bits, start, step, lambda state: state["done"])


def _root_exponents() -> list[int]:
    """Exponents that take n-th roots: of everything for odd n, of squares for even n."""
    return [pow(n, -1, PRIME - 1) if n % 2 else pow(n, -1, HALF) for n in range(1, MOST_ROOT + 1)]


def _hashed(seed: Column, name: Column, argument: Column | None = None) -> Column:
    """A fixed random square for a name, and value of its argument."""
    parts = [seed, name] + ([] if argument is None else [argument])
    return let(F.pmod(F.xxhash64(*parts), F.lit(PRIME)), lambda x: _times(x, x))


# --- Postfix order --------------------------------------------------------------------

_TOKEN_TYPE = "struct<t:string,k:string,h:bigint>"


def _token(t: Column | str, k: Column | str, h: Column | int) -> Column:
    """A token with its kind and how strongly it binds."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(t).alias("t"), lit(k).alias("k"), lit(h).cast("long").alias("h"))


def _kinds(tokens: Column) -> Column:
    """Tokens with kinds; products without a sign get one, and signs before an operand become prefixes."""
    kinds, heights = _constant(KINDS), _constant(OPERATORS | dict.fromkeys(FUNCTIONS, FUNCTION))

    def known(t: Column) -> Column:
        prefix = F.regexp_like(t, F.lit(r"^\\(sqrt|log_)"))
        other = F.when(F.regexp_like(t, F.lit(r"^\.?\d")), "n").when(F.regexp_like(t, F.lit("^[A-Za-z]")), "s").when(prefix, "f").otherwise("?")
        height = F.when(F.startswith(t, F.lit("\\sqrt")), ROOT).when(prefix, FUNCTION).otherwise(0)
        return _token(t, F.coalesce(F.try_element_at(kinds, t), other), F.coalesce(F.try_element_at(heights, t), height))

    def placed(marked: Column) -> Column:
        def with_neighbour(token: Column, i: Column) -> Column:
            before = F.coalesce(F.get(marked, i - 1)["k"], F.lit("?"))
            ended = F.contains(F.lit(ENDS), before)
            sign = token["t"].isin("+", "-") & ~ended
            return (
                F.when(sign & (token["t"] == "+"), F.expr(f"cast(array() as array<{_TOKEN_TYPE}>)"))
                .when(sign, F.array(_token("neg", "f", NEGATION)))
                .when(ended & F.contains(F.lit(BEGINS), token["k"]), F.array(_token("*", "o", OPERATORS["*"]), token))
                .otherwise(F.array(token))
            )

        return F.flatten(F.transform(marked, with_neighbour))

    return let(F.transform(tokens, known), placed)


def _state(out: Column, ops: Column, ok: Column) -> Column:
    return F.struct(out.alias("out"), ops.alias("ops"), ok.alias("ok"))


def _step(state: Column, token: Column) -> Column:
    kind = token["k"]
    # What is pending on top and binds at least so strongly goes out first. Powers group to
    # the right; brackets, commas and the end let everything go that no bracket holds back.
    least = F.when(kind == "o", token["h"] + (token["t"] == "^").cast("long")).when(kind.isin(")", "h", ","), F.lit(1)).otherwise(F.lit(99))
    kept = F.coalesce(F.array_max(F.transform(state["ops"], lambda op, i: F.when(op["h"] < least, i + 1))), F.lit(0))

    def popped(n: Column) -> Column:
        ops = F.slice(state["ops"], F.lit(1), n)
        out = F.concat(state["out"], F.reverse(F.slice(state["ops"], n + 1, F.size(state["ops"]))))
        top, below = F.get(ops, n - 1)["k"], F.get(ops, n - 2)
        inner = F.slice(ops, F.lit(1), n - 1)
        over = F.array_append(out, _token("/", "o", OPERATORS["/"]))
        opened = state["ok"] & F.coalesce(top == "(", F.lit(False))
        return (
            F.when(kind.isin("f", "(", "q"), _state(state["out"], F.array_append(state["ops"], token), state["ok"]))
            .when(kind.isin("n", "s", "!"), _state(F.array_append(state["out"], token), state["ops"], state["ok"]))
            .when(kind == "o", _state(out, F.array_append(ops, token), state["ok"]))
            .when((kind == ")") & F.coalesce(below["k"] == "q", F.lit(False)), _state(over, F.slice(ops, F.lit(1), n - 2), opened))
            .when(kind == ")", _state(out, F.when(n > 0, inner).otherwise(ops), opened))
            .when(kind == "h", _state(out, ops, opened & F.coalesce(below["k"] == "q", F.lit(False))))
            .when(kind == ",", _state(F.array_append(out, token), ops, state["ok"] & (n == 0)))
            .otherwise(_state(out, ops, F.lit(False)))
        )

    # Pending brackets have no height, so ``n`` never cuts below the innermost one.
    return F.when(state["ok"], let(kept, popped)).otherwise(state)


def postfix(tokens: Column) -> Column:
    """Tokens in postfix order, items of a list closed by commas; null if they make no expression."""
    none = F.expr(f"cast(array() as array<{_TOKEN_TYPE}>)")
    closed = F.array_append(_kinds(tokens), _token(",", ",", 0))
    return F.aggregate(closed, _state(none, none, F.lit(True)), _step, lambda s: F.when(s["ok"], s["out"]))


# --- Values ---------------------------------------------------------------------------

_VALUE = "struct<v:bigint,n:bigint,d:bigint>"


def _value(v: Column, n: Column | None = None, d: Column | None = None) -> Column:
    """A value, and as long as it is known the fraction n / d that it is, for exponents."""
    null = F.expr("cast(null as bigint)")
    return F.struct(v.cast("long").alias("v"), (null if n is None else n).cast("long").alias("n"), (null if d is None else d).cast("long").alias("d"))


def _number(token: Column) -> Column:
    digits = F.replace(token, F.lit("."), F.lit(""))
    places = F.when(F.contains(token, F.lit(".")), F.length(F.substring_index(token, ".", -1))).otherwise(F.lit(0))
    residue = (digits.try_cast("decimal(38,0)") % F.lit(PRIME)).cast("long")
    parts_of_ten = F.get(_constant([pow(10, -k, PRIME) for k in range(39)]), places)
    short = (F.length(digits) <= 15) & (places <= 15)
    return _value(_times(residue, parts_of_ten), F.when(short, digits.try_cast("long")), F.when(short, F.pow(F.lit(10), places)))


def _binary(op: Column, a: Column, b: Column) -> Column:
    """``a op b``; as ``\\sqrt`` too, whose ``b`` is the exponent."""
    other = F.when(op == "-", -b["n"]).otherwise(b["n"])
    change = F.when(op == "-", F.lit(PRIME) - b["v"]).otherwise(b["v"])
    add = _value((a["v"] + change) % F.lit(PRIME), F.try_add(F.try_multiply(a["n"], b["d"]), F.try_multiply(other, a["d"])), F.try_multiply(a["d"], b["d"]))
    times = _value(_times(a["v"], b["v"]), F.try_multiply(a["n"], b["n"]), F.try_multiply(a["d"], b["d"]))
    return F.when(op.isin("+", "-"), add).when(op == "*", times).otherwise(_raised(op == "/", a, b))


def _raised(over: Column, a: Column, b: Column) -> Column:
    """``a / b`` or ``a`` to the rational ``b``.

    The value is null if there is none: a division by zero, an exponent that is not known
    to be rational, an even root of what is not a square.
    """
    whole = F.coalesce(F.try_mod(b["n"], b["d"]) == 0, F.lit(False))
    below = F.when(whole, F.lit(1)).otherwise(b["d"])
    top = F.when(whole, F.expr("1") * (b["n"] / b["d"])).otherwise(b["n"]).cast("long")
    exponent = F.when(below.between(1, MOST_ROOT), F.get(_constant(_root_exponents()), (below - 1).cast("int")))
    root = F.when(over, b["v"]).when(below == 1, a["v"]).otherwise(_power(a["v"], exponent))

    def of(r: Column) -> Column:
        is_root = over | (below % 2 == 1) | (_power(r, below) == a["v"])
        by = F.when(over, F.lit(PRIME - 2)).otherwise(F.pmod(top, F.lit(PRIME - 1)))
        defined = is_root & ((r != 0) | (~over & (top > 0)))
        raised = F.when(defined, _power(r, by))
        sign = F.signum(b["n"]).cast("long")
        small = ~over & (below == 1) & top.between(0, 6) & (F.abs(a["n"]) < 1000) & (a["d"] < 1000)
        n = F.when(over & (b["n"] != 0), F.try_multiply(a["n"], b["d"]) * sign).when(small, F.round(F.pow(a["n"], top)))
        d = F.when(over & (b["n"] != 0), F.try_multiply(a["d"], F.abs(b["n"]))).when(small, F.round(F.pow(a["d"], top)))
        return _value(F.when(over, _times(a["v"], raised)).otherwise(raised), n, d)

    return let(root, of)


def _unary(op: Column, a: Column, seed: Column) -> Column:
    exact = F.when((a["d"] == 1) & a["n"].between(0, MOST_FACTORIAL), F.get(_constant([factorial(n) for n in range(MOST_FACTORIAL + 1)]), a["n"].cast("int")))
    return (
        F.when(op == "neg", _value(F.pmod(-a["v"], F.lit(PRIME)), -a["n"], a["d"]))
        .when(op == "%", _value(_times(a["v"], F.lit(pow(100, -1, PRIME))), a["n"], F.try_multiply(a["d"], F.lit(100).cast("long"))))
        .when(op == "!", _value(exact % F.lit(PRIME), exact, F.lit(1)))
        .otherwise(_value(F.when(a["v"].isNotNull(), _hashed(seed, op, a["v"]))))
    )


def _values(ordered: Column, seed: Column) -> Column:
    """Values of the items of a postfix list; null if any has none."""

    def state(stack: Column, done: Column, ok: Column) -> Column:
        return F.struct(stack.alias("stack"), done.alias("done"), ok.alias("ok"))

    empty = F.expr(f"cast(array() as array<{_VALUE}>)")

    def step(s: Column, token: Column) -> Column:
        op, kind, stack, done = token["t"], token["k"], s["stack"], s["done"]
        size = F.size(stack)
        last, before = F.get(stack, size - 1), F.get(stack, size - 2)
        is_root = F.startswith(op, F.lit("\\sqrt"))
        operands = F.when(kind.isin("n", "s"), 0).when(kind == "o", 2).otherwise(1)
        degree = F.coalesce(F.regexp_extract(op, r"(\d+)", 1).try_cast("long"), F.lit(2).cast("long"))
        exponent = F.when(is_root, _value(F.lit(1), F.lit(1), degree)).otherwise(last)
        value = (
            F.when(kind == "n", _number(op))
            .when(kind == "s", _value(_hashed(seed, op)))
            .when((kind == "o") | is_root, _binary(op, F.when(is_root, last).otherwise(before), exponent))
            .otherwise(_unary(op, last, seed))
        )
        rest = F.slice(stack, F.lit(1), F.greatest(size - operands, F.lit(0)))
        replaced = let(value, lambda x: state(F.array_append(rest, x), done, (size >= operands) & x["v"].isNotNull()))
        ended = state(empty, F.array_append(done, last["v"]), size == 1)
        return F.when(~s["ok"], s).when(kind == ",", ended).otherwise(replaced)

    start = state(empty, F.expr("cast(array() as array<bigint>)"), F.lit(True))
    return F.aggregate(ordered, start, step, lambda s: F.when(s["ok"], s["done"]))


# --- Answers --------------------------------------------------------------------------

_BRACKETED = r"^(\\\{|[(\[])(.*,.*)(\\\}|[)\]])$"


def _plain(answer: Column) -> Column:
    """Answer without what does not count, ready to be cut into tokens."""
    for pattern, replacement in REWRITES:
        answer = F.regexp_replace(answer, F.lit(pattern), F.lit(replacement))
    # Outside brackets, three digits behind a comma are thousands.
    grouped = F.regexp_replace(answer, F.lit(THOUSANDS), F.lit(""))
    answer = F.when(F.regexp_like(answer, F.lit(r"[(\[{]")), answer).otherwise(grouped)
    return F.regexp_replace(strip(answer), F.lit(r"[.]$"), F.lit(""))


def _read(answer: Column) -> Column:
    """Brackets around a list and the postfix order of what is in them."""

    def parts(text: Column) -> Column:
        listed = F.regexp_like(text, F.lit(_BRACKETED))
        open_, close = (F.when(listed, F.regexp_extract(text, _BRACKETED, k)).otherwise(F.lit("")) for k in (1, 3))
        inner = F.when(listed, F.regexp_extract(text, _BRACKETED, 2)).otherwise(text)
        # Words alone are text: letters would be multiplied, in any order.
        readable = ~F.regexp_like(text, F.lit(r"^[A-Za-z\s]{2,}$")) & (text != "")
        tokens = F.transform(F.regexp_extract_all(inner, F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, r"\}\s+\{", "}{"))
        return F.struct(open_.alias("open"), close.alias("close"), F.when(readable, postfix(tokens)).alias("order"))

    return let(_plain(answer), parts)


def same_expression(left: Column, right: Column) -> Column:
    """Whether two answers are expressions of equal value.

    Items of tuples and intervals are compared in order, those of sets and of lists without
    brackets in any; brackets have to be of the same kind. False if either side is null or
    not understood.
    """

    def compare(sides: Column) -> Column:
        a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        unordered = a["open"].isin("", "\\{")

        def agree(seed: Column) -> Column:
            values = F.transform(sides, lambda side: _values(side["order"], seed))
            ordered = F.transform(values, lambda x: F.when(unordered, F.sort_array(x)).otherwise(x))
            return let(ordered, lambda x: F.coalesce(F.get(x, F.lit(0)) == F.get(x, F.lit(1)), F.lit(False)))

        same_brackets = (a["open"] == b["open"]) & (a["close"] == b["close"])
        read = a["order"].isNotNull() & b["order"].isNotNull() & same_brackets
        # Points differ in names and functions only.
        named = F.exists(a["order"], lambda token: token["k"].isin("s", "f"))
        points = F.when(named, _constant(SEEDS)).otherwise(_constant(SEEDS[:1]))
        return F.when(read, F.forall(points, agree)).otherwise(F.lit(False))

    compared = let(F.transform(F.array(left, right), _read), compare)
    return F.when(left.isNotNull() & right.isNotNull(), compared).otherwise(F.lit(False))
