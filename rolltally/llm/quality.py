"""Quality rules with thresholds that adapt to each language and source.

All of it is DataFrame functions. Each document's statistics are whole numbers; per language
and source, a histogram sketch of each statistic (counts of equal-width bins, so sketches
merge by adding) gives its quartiles, and what lies far beyond them fails. Groups with few
documents use their language's merged sketch.

With ``tail``, upper limits have no fixed floors: where a rule's quartiles lie closer than the
statistic resolves, its limit is the quantile ``tail`` (per cent) of the same sketch.

Defined results: null texts have no words and fail the base rules; null languages and
sources are groups like others; where even the language has fewer than ``MIN_GROUP``
documents that pass the base rules, only these apply. Rows that repeat are rows of the
result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolltally.llm.common import handover, named

SPACE = r"[\x20\x09-\x0D]"
IN_WORD = r"[^\x20\x09-\x0D]"
MIN_GROUP = 20
# Limits lie this many interquartile ranges beyond the quartiles.
REACH = 3
# Statistic -> (its value as a whole number, the least that its upper limit can be, whether
# it has a lower limit too, the least distance of limits from the quartiles).
RULES = {
    "symbols": ("(1000 * n_symbols) div n_words", 150, False, 0),
    "copied_lines": ("(1000 * n_dup_lines) div greatest(n_lines, 1)", 300, False, 0),
    "repeats": ("(1000 * n_repeat_words) div n_words", 250, False, 0),
    "capitals": ("(1000 * n_capitals) div word_chars", 300, False, 0),
    "length": ("(100 * word_chars) div n_words", 0, True, 200),
}
# The quantile, in per cent, for rules without spread: the last of MIN_GROUP documents exceeds it.
TAIL = 95
# What one more symbol, repeated word or capital comes to in the shortest texts that are judged.
RESOLUTION = {"symbols": 20, "copied_lines": 20, "repeats": 20, "capitals": 4}
# Bins of a sketch are the whole numbers up to here and beyond, then ever wider: a value keeps
# its first BIN_BITS bits. There is no last bin, and wide ones merge by adding just as well.
TOP_BIN = 5000
BIN_BITS = 13
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def base_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the statistics and ``base_failed``; no shuffle.

    Repeated 3-word windows are found inside the row. Each window becomes one whole number,
    a hash above its position; sorted, equal windows are neighbours. Windows whose hashes
    agree are then compared by their words, so the counts are exact.
    """
    text = F.coalesce(named(docs, "text").cast("string"), F.lit(""))
    rows = docs.select(
        named(docs, "doc_id").cast("long").alias("doc_id"),
        named(docs, "lang").cast("string").alias("lang"),
        named(docs, "source").cast("string").alias("source"),
        text.alias("t"),
    )
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(IN_WORD))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.array_remove(F.split("t", SPACE + "+"), "").alias("w"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        "w",
        "n_symbols",
        "n_capitals",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("w"))).alias("bits"),
    )
    done = ["doc_id", "lang", "source", "n", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals"]
    rows = rows.select(
        *done,
        "w",
        "bits",
        F.expr(
            "sort_array(CASE WHEN n >= 3 THEN transform(sequence(0, n - 3), i ->"
            " shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | CAST(i AS BIGINT)) ELSE array() END)"
        ).alias("s"),
    )
    rows = rows.select(
        *done,
        "w",
        "bits",
        F.expr(
            "filter(s, (x, j) -> (j > 0 AND shiftright(s[j - 1], bits) = shiftright(x, bits))"
            " OR (j + 1 < size(s) AND shiftright(s[j + 1], bits) = shiftright(x, bits)))"
        ).alias("c"),
    )
    rows = rows.select(
        *done,
        F.expr(
            "array_sort(transform(transform(c, x -> CAST(x & (shiftleft(1L, bits) - 1) AS INT)),"
            " p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) AS k, p AS p)))"
        ).alias("g"),
    )
    rows = rows.select(
        *done,
        F.expr(
            "sort_array(transform(filter(g, (x, j) -> (j > 0 AND g[j - 1].k = x.k)"
            " OR (j + 1 < size(g) AND g[j + 1].k = x.k)), x -> x.p))"
        ).alias("r"),
    )
    # Each window adds the words that the one before it does not hold.
    covered = "aggregate(r, named_struct('c', 0L, 'last', -3), (a, p) -> named_struct('c', a.c + least(3, p - a.last), 'last', p), a -> a.c)"
    rows = rows.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), *done[4:], F.expr(covered).alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bin_of(value: str) -> Column:
    """The bin of a statistic, for the sketches as for what is judged by them."""
    wide = f"greatest(length(bin({value})) - {BIN_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright(CAST({value} AS BIGINT), {wide}), {wide})")


def sketches(stats: DataFrame) -> DataFrame:
    """Histogram sketches: ``lang``, ``source``, ``rule``, ``bin``, ``n``.

    Counted from what passes the base rules. Tasks send one row per bin that occurs, however
    many documents a source has. Sketches of sources merge to that of their language by adding.
    """
    values = [F.struct(F.lit(name).alias("rule"), bin_of(value).alias("bin")) for name, (value, *_) in RULES.items()]
    each = stats.where("NOT base_failed").select("lang", "source", F.explode(F.array(*values)).alias("x"))
    return each.groupBy("lang", "source", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def _limits(sketch: DataFrame, by: list[str], tail: int | None) -> DataFrame:
    """Lower and upper limit per group and rule, from the quartiles (and tail) of the merged sketch."""
    merged = sketch.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    quartiles = ranked.groupBy(*by, "rule").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
        F.min(F.when(100 * F.col("below") >= F.lit(tail or 100) * F.col("total"), F.col("bin"))).alias("tail"),
    )
    reach = REACH * (F.col("q3") - F.col("q1"))
    out = []
    for name, (_, floor, two_sided, slack) in RULES.items():
        far = F.greatest(reach, F.lit(slack))
        high = F.greatest(F.col("q3") + far, F.lit(floor))
        if tail is not None and name in RESOLUTION:
            least = RESOLUTION[name]
            beyond = F.greatest(F.col("tail"), F.col("q3") + reach) + least
            high = F.when(F.col("q3") - F.col("q1") < least, beyond).otherwise(F.col("q3") + reach)
        out.append((name, high, F.col("q1") - far if two_sided else F.lit(-1)))
    high, low = F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, top, bottom in out:
        high, low = F.when(F.col("rule") == name, top).otherwise(high), F.when(F.col("rule") == name, bottom).otherwise(low)
    wide = quartiles.where(F.col("total") >= MIN_GROUP).groupBy(*by)
    return wide.pivot("rule", list(RULES)).agg(F.max(high).alias("high"), F.max(low).alias("low"))


def thresholds(sketch: DataFrame, tail: int | None = None) -> DataFrame:
    """Limits per ``lang`` and ``source`` that occur, from the source's sketch or its language's."""
    names = [f"{rule}_{side}" for rule in RULES for side in ("high", "low")]
    own = _limits(sketch, ["lang", "source"], tail)
    merged = _limits(sketch, ["lang"], tail)
    groups = sketch.select("lang", "source").distinct().alias("g")
    joined = groups.join(own.alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
    joined = joined.join(merged.alias("m"), F.col("g.lang").eqNullSafe(F.col("m.lang")), "left")
    return joined.select("g.lang", "g.source", *(F.coalesce(f"o.{n}", f"m.{n}").alias(n) for n in names))


def quality_filter(spark: SparkSession, docs: DataFrame, tail: int | None = None) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document.

    The statistics (a few numbers per document) are written once, sketched, and filtered by
    a join with the limits of their language and source.
    """
    stats = handover(spark, base_statistics(docs), "quality-statistics")
    limits = handover(spark, thresholds(sketches(stats), tail), "quality-limits").alias("l")
    s = stats.alias("s")
    joined = s.join(limits, F.col("s.lang").eqNullSafe(F.col("l.lang")) & F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    kept = ~F.col("base_failed")
    for rule, (value, *_) in RULES.items():
        # Text that passes the base rules has words; others are not judged further.
        measured = F.when(~F.col("base_failed"), bin_of(value))
        kept &= F.coalesce(measured.between(F.col(f"{rule}_low"), F.col(f"{rule}_high")), F.lit(True))
    return joined.select("s.doc_id", "s.lang", "s.source", *STATISTICS, "base_failed", kept.alias("kept"))
