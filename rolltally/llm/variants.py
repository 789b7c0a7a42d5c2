"""Spelling variants: words one edit apart, found by permuterm rotations.

Every word is closed by a terminator and rotated to each of its positions. Skipping the last
code point of a rotation leaves a prefix that says all of the word but for one code point and
where it stood: words that differ by replacing it share that prefix, and the word without it
has the prefix as one of its own rotations. So all rotations, whole and skipping, are sorted
by that prefix, and a scan over the sorted rows hands every word the number of its neighbours
in the group and the best of them. A group holds at most one word for each letter of the
alphabet and one without, so it is bounded whatever the corpus; no pairs are written.

A neighbour that lacks one of several equal letters in a row would be met once for each of
them: it is taken where the last of them is skipped only.

Defined results: a null text has no words; a null id is written as nothing where ids spoil
words; rows that repeat an id and text count like any others; an empty table has no words.
Other columns, of whatever names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm.common import handover, named

RUN = re.compile("[A-Za-zÀ-ÿ]+")
# Ends a word; runs hold letters only, so none contains it.
TERMINATOR = "$"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
# Distinct words a task counts before it hands them on.
HELD_WORDS = 200_000


def spoiled(run: str, prefix_crc: int, one_in: int) -> str:
    """The run, or what is left of it without one code point, by the checksum of id and run."""
    h = crc32(run.encode(), prefix_crc)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, spoil_one_in: int | None = None, least_length: int = LEAST_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of letters with A to Z in lower case, counted over all texts.

    With ``spoil_one_in`` one of so many (document, run) loses a code point first, chosen by
    the checksum of ``<id>:<run>``: known misspellings to measure with.
    """

    def count(batches):
        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if not value:
                    continue
                here = Counter(m.group() for m in RUN.finditer(value.encode().lower().decode()))
                start = crc32(f"{key or ''}:".encode())
                for run, n in here.items():
                    if len(run) < least_length:
                        continue
                    if spoil_one_in is not None:
                        run = spoiled(run, start, spoil_one_in)
                        if len(run) < least_length:
                            continue
                    found[run] += n
                if len(found) > HELD_WORDS:
                    yield rows()
                    found.clear()
        yield rows()

    source = docs.select(named(docs, doc_id).cast("string").alias("doc_id"), named(docs, text).cast("string").alias("text"))
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """Rows (``key``, ``word``, ``n``, ``skips``, ``last``) of all rotations of terminated words.

    A rotation stands as it is (``skips`` false) and, unless the terminator is last, without
    its last code point; ``last`` tells whether the skipped one is the last of equal ones.
    """
    turned = words.select("word", "n", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    rotation = F.concat(F.expr("substring(word, at + 1)"), F.lit(TERMINATOR), F.expr("substring(word, 1, at)"))
    turned = turned.select("word", "n", "size", "at", rotation.alias("rotation"))
    whole = F.struct(F.col("rotation").alias("key"), F.lit(False).alias("skips"), F.lit(False).alias("last"))
    skipping = F.struct(
        F.expr("substring(rotation, 1, size)").alias("key"),
        F.lit(True).alias("skips"),
        (F.expr("substring(word, at, 1)") != F.expr("substring(word, at + 1, 1)")).alias("last"),
    )
    both = F.when(F.col("at") > 0, F.array(whole, skipping)).otherwise(F.array(whole))
    return turned.select("word", "n", F.explode(both).alias("row")).select("row.key", "word", "n", "row.skips", "row.last")


def _firsts(chosen: np.ndarray, group: np.ndarray, groups: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second chosen position of every group, ``none`` where there is no such row."""
    at = np.flatnonzero(chosen)
    of = group[at]
    first, second = np.full(groups, none), np.full(groups, none)
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = of[1:] != of[:-1]
    first[of[begins]] = at[begins]
    after = np.flatnonzero(begins) + 1
    after = after[after < len(at)]
    after = after[~begins[after]]
    second[of[after]] = at[after]
    return first, second


def _scan_groups(batches):
    """From rotations sorted by key, frequent words first: what each word meets in its group."""

    def emit(rows, new):
        group = np.cumsum(new) - 1
        total, groups = len(group), int(group[-1]) + 1
        skips, last = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("skips", "last"))
        last = last & skips
        skipping, dropped = np.bincount(group[skips], minlength=groups), np.bincount(group[last], minlength=groups)
        first_skip, second_skip = _firsts(skips, group, groups, total)
        first_last, _ = _firsts(last, group, groups, total)
        whole, _ = _firsts(~skips, group, groups, total)
        at = np.arange(total)
        met = np.where(skips, skipping[group] - 1 + (last & (whole[group] < total)), dropped[group])
        other = np.where(first_skip[group] == at, second_skip[group], first_skip[group])
        best = np.where(skips, np.where(last, np.minimum(other, whole[group]), other), first_last[group])
        keep = met > 0
        words, counts = rows.column("word"), rows.column("n")
        mine, theirs = pa.array(at[keep]), pa.array(best[keep])
        return pa.RecordBatch.from_arrays([words.take(mine), pa.array(met[keep].astype(np.int64)), words.take(theirs), counts.take(theirs)], names=["word", "met", "near", "near_n"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        rows = rows.combine_chunks()
        if not len(rows):
            continue
        rows = rows.to_batches()[0]
        key = rows.column("key")
        new = np.ones(len(rows), dtype=bool)
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield emit(rows.slice(0, cut), new[:cut])
        held = pa.Table.from_batches([rows.slice(cut)])
    if held is not None and len(held):
        rows = held.combine_chunks().to_batches()[0]
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        yield emit(rows, new)


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and the most frequent near word (``near``, ``near_n``), smallest first.

    ``words`` has distinct ``word`` with ``n``. Words without near ones have no row.
    """
    ordered = rotations(words).repartition("key").sortWithinPartitions("key", F.desc("n"), "word")
    met = ordered.mapInArrow(_scan_groups, "word string, met long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = met.groupBy("word").agg(F.sum("met").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, where following ``form`` from ``word`` ends; forms make no circles.

    Each turn doubles the steps known, and is a written table; one flag reaches the driver.
    """
    reach = handover(spark, forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while reach.where("moved").limit(1).count():
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reach.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        reach = handover(spark, step, "roots")
    return reach.select("word", "root")


def spelling_variants(spark: SparkSession, words: DataFrame, times: int = TIMES) -> DataFrame:
    """Every word with its form, root and near words.

    ``words`` has distinct ``word`` with ``n``. A word's ``form`` is its most frequent near
    word (of equal ones the smallest), if that occurs ``times`` as often; ``root`` is where
    forms of forms lead, the word itself if it has none.
    """
    found = neighbours(words)
    marked = words.join(found, "word", "left").withColumn("is_variant", F.coalesce(F.col("near_n") >= F.col("n") * times, F.lit(False)))
    marked = handover(spark, marked, "variants")
    led = roots(spark, marked.where("is_variant").select("word", F.col("near").alias("form")))
    return marked.join(led, "word", "left").select(
        "word",
        F.when(F.col("is_variant"), F.col("near")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("is_variant"), F.col("near_n")).alias("form_n"),
    )


def variants_of(spark: SparkSession, docs: DataFrame, spoil_one_in: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``spelling_variants`` of the words of ``docs`` that have so many letters and occurrences."""
    words = word_counts(docs, spoil_one_in, least_length).where(F.col("n") >= least_count)
    return spelling_variants(spark, handover(spark, words, "vocabulary"), times)
