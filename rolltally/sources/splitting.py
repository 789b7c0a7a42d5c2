"""CSV files with line breaks in fields, and JSON arrays, read by many tasks each.

Such a file cannot be cut anywhere: whether a place lies inside a quoted field, or how deep
inside brackets, depends on all that stands before it. Spark's text reader deals out byte
ranges as pieces (lines of a CSV file, stretches up to a closing brace of a JSON file). A
task passes over its range once under both assumptions, that it begins inside quotes and
that it does not, and notes for each where it would end. A range thus sums up to a function
of how it begins, and such functions compose: a prefix scan over one row per range tells
every range how it begins in truth. Pieces that are whole records go on where they are;
only records that consist of several pieces are put together by a shuffle.

Files are passed over once for the ranges and twice for the records (whole ones and others).
Compressed files are one range each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLACE = "file string, range long, no long, text string"
# Per assumption on the quotes at a range's begin: whether the piece begins and ends inside
# quotes; the depth in brackets before and after it, from the range's begin; the least depth
# that a record could end at before it, and how often one did.
_SCANNED = _PLACE + ", " + ", ".join(f"in{h} boolean, out{h} boolean, before{h} long, after{h} long, least{h} long, ended{h} long" for h in (0, 1))
_NAMES = [f.split()[0] for f in _SCANNED.split(", ")]
# No record could have ended yet.
_NEVER = 1 << 40


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("text"))


class _Assumption:
    """What passing over a range finds if it begins inside quotes, or if it does not."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.depth = inside, 0
        self.least, self.ended = _NEVER, 0

    def step(self, inside: bool, change: int) -> tuple:
        """Pass over a piece; a record may end where a piece ends outside quotes."""
        row = (self.inside, inside, self.depth, self.depth + change, self.least, self.ended)
        self.inside, self.depth = inside, self.depth + change
        if not inside:
            if self.depth < self.least:
                self.least, self.ended = self.depth, 0
            if self.depth == self.least:
                self.ended += 1
        return row


def _scan(pieces: DataFrame, effect: Callable[[str, bool], tuple[bool, int]]) -> DataFrame:
    """All pieces with what holds under both assumptions; ``effect`` tells what a piece does to each."""

    def scan(batches):
        place, number, both = None, 0, ()
        for batch in batches:
            rows = []
            for file, start, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, start) != place:
                    place, number, both = (file, start), 0, (_Assumption(False), _Assumption(True))
                rows.append((file, start, number, text, *(v for a in both for v in a.step(*effect(text, a.inside)))))
                number += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_NAMES)

    return pieces.mapInArrow(scan, _SCANNED)


def _ranges(scanned: DataFrame, level: int) -> DataFrame:
    """How every range begins: inside quotes or not, at what depth, and in which record.

    ``owner`` is the record left open before it, by its range and its number there; null
    where no record has ended before. One row per range is all that is ordered here.
    """
    last = F.max_by(F.struct(*_NAMES[4:]), "no")
    ends = scanned.groupBy("file", "range").agg(last.alias("end")).select("file", "range", "end.*")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A range either fixes how it ends, or keeps how it begins, or turns it over.
    fixed = F.col("out0") == F.col("out1")
    turns = F.coalesce(F.sum(F.when(~fixed & F.col("out0"), 1).otherwise(0)).over(before), F.lit(0))
    turned = ends.withColumns({"fixed": fixed, "turns": turns})
    last_fixed = F.last(F.when(F.col("fixed"), F.struct("out0", F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    known = turned.withColumn("last_fixed", last_fixed)
    odd = F.pmod(F.col("turns") - F.coalesce("last_fixed.turns", F.lit(0)), F.lit(2)) == 1
    known = known.withColumn("inside", F.coalesce("last_fixed.out0", F.lit(False)) != odd)
    deep = known.withColumn("depth", F.coalesce(F.sum(_true("after")).over(before), F.lit(0)))
    # Records that end in the range, its last piece included.
    wanted = F.lit(level) - F.col("depth")
    total = _earlier(wanted) + (~_true("out") & (_true("after") == wanted)).cast("long")
    counted = deep.withColumn("total", total)
    owner = F.last(F.when(F.col("total") > 0, F.struct("range", "total")), ignorenulls=True).over(before)
    return counted.select("file", "range", "inside", "depth", owner.alias("owner"))


def _true(name: str) -> Column:
    """What was found under the assumption that holds."""
    return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))


def _earlier(wanted: Column) -> Column:
    """Records that ended before a piece in its range. Below their depth nothing ends but the file."""
    return F.when(_true("least") == wanted, _true("ended")).otherwise(F.lit(0).cast("long"))


def _records(scanned: DataFrame, level: int, separator: str) -> DataFrame:
    """``file``, ``range`` and ``no`` of the first piece and ``text`` of all records.

    A record ends where a piece ends outside quotes at depth ``level``.
    """
    wanted = F.lit(level) - F.col("depth")
    pieces = scanned.join(_ranges(scanned, level), ["file", "range"]).select(
        *("file", "range", "no", "text", "owner"),
        (~_true("in") & (_true("before") == wanted) & ~_true("out") & (_true("after") == wanted)).alias("whole"),
        _earlier(wanted).alias("earlier"),
    )
    # What a range leaves open is closed by a later one: its first pieces belong to the record
    # that was left open before it, or to the file's first.
    leading = F.col("earlier") == 0
    keyed = pieces.where("NOT whole").select(
        "file",
        F.when(leading, F.coalesce("owner.range", F.lit(-1).cast("long"))).otherwise(F.col("range")).alias("at"),
        F.when(leading, F.coalesce("owner.total", F.lit(0).cast("long"))).otherwise(F.col("earlier")).alias("nth"),
        F.struct("range", "no", "text").alias("piece"),
    )
    joined = keyed.groupBy("file", "at", "nth").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    first = F.get("pieces", F.lit(0))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), separator)
    several = joined.select("file", first["range"].alias("range"), first["no"].alias("no"), text.alias("text"))
    return pieces.where("whole").select("file", "range", "no", "text").union(several)


# --- CSV ------------------------------------------------------------------------------


def _quotes_effect(separator: str) -> Callable[[str, bool], tuple[bool, int]]:
    """Quotes open a field at its begin only; inside, two of them stand for one."""
    opening = separator + '"'

    def effect(line: str, inside: bool) -> tuple[bool, int]:
        at = line.find('"')
        if at < 0:
            return inside, 0
        at, start = 0, not inside
        while True:
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return True, 0
                if line.startswith('""', at):
                    at += 2
                else:
                    inside, start, at = False, False, at + 1
            elif start and line.startswith('"'):
                inside, start, at = True, False, 1
            else:
                start, at = False, line.find(opening, at)
                if at < 0:
                    return False, 0
                inside, at = True, at + len(opening)

    return effect


def csv_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``file``, ``range``, ``no`` and ``text`` of every record, headers included, line breaks kept."""
    scanned = _scan(_pieces(spark, path, "\n"), _quotes_effect(separator))
    return _records(scanned, 0, "\n")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, separator: str = ",") -> DataFrame:
    """Rows of CSV files with headers, whose quoted fields may hold line breaks.

    Fields are parsed by Spark's own parser, record by record. Columns are named by the
    first file's header and are text unless a schema is given. Lines end in a line feed,
    before which a carriage return is dropped. Empty lines between records are passed over.
    """
    if schema is None:
        header = spark.read.option("header", True).option("escape", '"').option("sep", separator).option("multiLine", True).csv(path)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    records = csv_records(spark, path, separator)
    rows = records.where("NOT (range = 0 AND no = 0)").select(F.rtrim("text", F.lit("\r")).alias("text")).where("text <> ''")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE"}
    return rows.select(F.from_csv("text", ddl, options).alias("row")).select("row.*")


# --- JSON arrays ----------------------------------------------------------------------

_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _brackets_effect(piece: str, inside: bool) -> tuple[bool, int]:
    """Change of depth outside of strings; a piece is followed by the brace that ended it."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    change = sum(p.count("{") + p.count("[") - p.count("]") for p in parts[int(inside) :: 2])
    inside ^= len(parts) % 2 == 0
    return inside, change - (not inside)


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``range``, ``no`` and ``text`` of every object of arrays of objects, without line breaks."""
    scanned = _scan(_pieces(spark, path, "}"), _brackets_effect)
    records = _records(scanned, 1, "}")
    # What is left behind the last object holds none; line breaks stand between values only.
    begun = F.regexp_replace("text", r"^[\s,]*(?:\[\s*)?(?=\{)|[\n\r]", " ")
    return records.where(F.contains("text", F.lit("{"))).select("file", "range", "no", F.concat(begun, F.lit("}")).alias("text"))
