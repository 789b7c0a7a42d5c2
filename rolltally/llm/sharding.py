"""Dealing documents to shards by balanced label propagation, in DataFrame operations only.

The law kept is ``rows``: shards differ by one document at most. Within it, documents of one
group (equal texts, or any other key) are brought together as far as the shards hold them.

Every document starts in the shard its position in the table hashes to. Documents of a group
that start in the same cell (a fine division of the shards) move as one unit, so what is
iterated over is small: one row for each group and cell, nothing for documents without
companions. In each turn a unit looks at the shards of its group's other units and wants to
go to the one with most of its documents; shards that the group fills are left alone. How many may go from one shard to another is
limited by quotas: as many as go the other way, and the receiving shard's free room, dealt to
the others by what they want. Units are let through in an order that changes by turn, by
sums over hash buckets, so no group of movers is ever sorted in one task. Turns end when
nothing wants to move, or nothing has been let through.

Between turns shards may be a little over-full. A last step moves exactly the surplus
documents, those without companions first and then group by group, so that the
law holds to the row whatever the turns have left, and numbers the documents of each shard.

Defined results: a null text counts as an empty one (size 1, checksum 0) and is grouped with
these; null ids stay; rows that repeat an id and text are separate documents of one group; an
empty table gives an empty result. Other columns, of whatever names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolltally.llm.common import handover, named

SHARDS = 16
LAW = "rows"
# Documents of a group that move as one unit: so many at most on average in a group of all rows.
UNIT_ROWS = 1_000_000
# Buckets, over all pairs of shards, in which movers are let through.
BUCKETS = 1 << 16
MOST_SHARDS = 512
BLOCK_ROWS = 8192
# Share of a shard from which on a group holds it.
FILLED = 0.9
# Share by which shards may be over-full between turns.
SLACK = 0.1
MOST_TURNS = 20


def _group_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _ranked(rows: DataFrame, total: int, shards: int, by: str, first: Column, together: Column, part: Column) -> DataFrame:
    """Rows with ``rank``, gapless from 0 within each ``by``, those with small ``first`` ahead.

    Rows of equal hash ``together`` (and then ``part``) follow each other.

    Rows are numbered inside blocks of a bounded number of rows, and blocks are handed the
    number of rows ahead of them; only the blocks' counts are summed up in order.
    """
    blocks = max(1, math.ceil(total / shards / BLOCK_ROWS))
    placed = rows.withColumns({"_first": first, "_block": F.pmod(together, F.lit(blocks)), "_part": part})
    keys = [by, "_first", "_block", "_part"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_first", "_block", "_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*keys, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys).orderBy(together, "rid")
    numbered = placed.withColumn("_nth", F.row_number().over(inside) - 1).join(ahead, keys)
    return numbered.withColumn("rank", (F.col("_ahead") + F.col("_nth")).cast("long")).drop(*keys[1:], "_nth", "_ahead")


def _quotas(wishes: DataFrame, load: DataFrame, capacity: int) -> DataFrame:
    """How many documents may go ``from`` one shard ``to`` another, from at most one row a pair.

    What goes both ways leaves sizes as they are; the rest shares the receiver's free room in
    proportion to what is wanted.
    """
    back = wishes.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("wanted").alias("returned"))
    both = wishes.join(back, ["from", "to"], "left").withColumn("swapped", F.least("wanted", F.coalesce("returned", F.lit(0))))
    both = both.withColumn("left", F.col("wanted") - F.col("swapped"))
    room = load.select(F.col("label").alias("to"), F.greatest(F.lit(capacity) - F.col("rows"), F.lit(0)).alias("room"))
    both = both.join(room, "to", "left").withColumn("room", F.coalesce("room", F.lit(capacity)))
    asked = F.sum("left").over(Window.partitionBy("to"))
    share = F.when(asked <= F.col("room"), F.col("left")).otherwise(F.floor(F.col("left") * F.col("room") / asked))
    return both.select("from", "to", (F.col("swapped") + share).alias("quota"))


def _turn(state: DataFrame, capacity: int, shards: int, turn: int) -> DataFrame:
    """One turn of propagation over units (``g``, ``h``, ``cell``, ``label``, ``rows``, and ``of``, the group's rows).

    Adds ``moved``: whether the unit has gone elsewhere.
    """
    held = state.groupBy("g", "h", "label").agg(F.sum("rows").alias("held"))
    # Of shards that hold equally many, a hash decides, another one each turn. A shard that a
    # group nearly fills by itself keeps what it has; the rest of the group gathers elsewhere.
    filled = F.col("held") >= FILLED * capacity
    best = F.max(F.when(~filled, F.struct("held", F.xxhash64("g", "label", F.lit(turn)).alias("tie"), "label")))
    stays = F.collect_list(F.when(filled, F.col("label")))
    wanted = held.groupBy("g", "h").agg(best.alias("best"), stays.alias("stays")).select("g", "h", F.col("best.label").alias("to"), "stays")
    buckets = max(1, BUCKETS // shards**2)
    units = state.join(wanted, ["g", "h"])
    units = units.withColumn("to", F.when(F.array_contains("stays", F.col("label")) | F.col("to").isNull(), F.col("label")).otherwise(F.col("to"))).drop("stays")
    units = units.withColumn("bucket", F.pmod(F.xxhash64("g", "h", "cell", F.lit(turn)), F.lit(buckets)))
    load = state.groupBy("label").agg(F.sum("rows").alias("rows"))
    moving = units.where(F.col("to") != F.col("label")).groupBy(F.col("label").alias("from"), "to", "bucket").agg(F.sum("rows").alias("n"))
    quotas = _quotas(moving.groupBy("from", "to").agg(F.sum("n").alias("wanted")), load, capacity)
    so_far = F.sum("n").over(Window.partitionBy("from", "to").orderBy("bucket"))
    open_buckets = moving.withColumn("so_far", so_far).join(quotas, ["from", "to"]).where("so_far <= quota")
    # At most BUCKETS rows, or one for each pair of shards, which are bounded too.
    passes = open_buckets.select(F.col("from").alias("label"), "to", "bucket", F.lit(True).alias("passes"))
    decided = units.join(F.broadcast(passes), ["label", "to", "bucket"], "left")
    moved = F.coalesce("passes", F.lit(False))
    return decided.select("g", "h", "cell", F.when(moved, F.col("to")).otherwise(F.col("label")).alias("label"), "rows", "of", moved.alias("moved"))


def propagate(spark: SparkSession, units: DataFrame, total: int, shards: int = SHARDS, most_turns: int = MOST_TURNS) -> DataFrame:
    """Labels of units after the turns; a turn's result is a written table, two sums reach the driver."""
    capacity = math.ceil(total / shards * (1 + SLACK))
    state = units
    for turn in range(most_turns):
        state = handover(spark, _turn(state, capacity, shards, turn), "shard-labels")
        moved = state.agg(F.sum(F.col("moved").cast("long"))).first()[0]
        state = state.drop("moved")
        if not moved:
            break
    return state


def _settled(spark: SparkSession, labelled: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows with ``shard``, sizes at most one apart; ``linked`` rows move last, and group by group."""
    whole, rest = divmod(total, shards)
    counted = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.count(F.lit(1))).collect()}  # one row a shard
    # Larger shards take the odd rows, which saves moves.
    order = sorted(range(shards), key=lambda s: (-counted.get(s, 0), s))
    over = {s: counted.get(s, 0) - whole - (k < rest) for k, s in enumerate(order)}
    # The surplus of all shards in a row, and the open places likewise.
    nth, target, leaving, filled = F.lit(None).cast("long"), F.lit(None).cast("int"), 0, sum(-n for n in over.values() if n < 0)
    for s in range(shards):
        if over[s] > 0:
            nth = F.when((F.col("label") == s) & (F.col("rank") < over[s]), F.col("rank") + leaving).otherwise(nth)
            leaving += over[s]
        elif over[s] < 0:
            target = F.when(F.col("nth") < filled, F.lit(s)).otherwise(target)
            filled += over[s]
    # Surplus of groups goes group by group; a group too large for a block is cut into parts.
    parts = F.greatest(F.lit(1), F.ceil(F.col("of") / BLOCK_ROWS)).cast("int")
    part = F.pmod(F.xxhash64("rid", F.lit("part")), parts)
    ranked = _ranked(labelled, total, shards, "label", F.col("linked").cast("int"), F.col("together"), part).withColumn("nth", nth)
    return ranked.select("rid", "row", "size", "text_crc32", F.coalesce(target, "label").cast("int").alias("shard"))


def balanced_shards(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = SHARDS,
    group: Column | None = None,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    most_turns: int = MOST_TURNS,
) -> DataFrame:
    """One row per document: its columns ``keep`` in ``row``, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``group`` names what belongs together (a column of ``docs``; by default the text); rows
    with a null group belong to none. ``slot`` numbers the documents of a shard from 0.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards has to be from 1 to {MOST_SHARDS}.")
    words = F.coalesce(named(docs, text).cast("string"), F.lit(""))
    g, h = _group_key(words if group is None else group.cast("string"))
    tagged = docs.select(
        # Numbers rows for good only once they are written.
        F.monotonically_increasing_id().alias("rid"),
        F.struct(*(named(docs, c).alias(c) for c in keep)).alias("row"),
        g.alias("g"),
        h.alias("h"),
        (F.lit(False) if group is None else group.isNull()).alias("alone"),
        (F.octet_length(words) + 1).cast("long").alias("size"),
        F.crc32(words.cast("binary")).alias("text_crc32"),
    )
    tagged = handover(spark, tagged, "shard-rows")
    total = tagged.count()
    cells = shards * max(16, math.ceil(total / UNIT_ROWS))
    cell = F.pmod(F.xxhash64("rid"), F.lit(cells)).cast("int")
    rows = tagged.withColumn("cell", cell)
    units = rows.where("not alone").groupBy("g", "h", "cell").agg(F.count(F.lit(1)).alias("rows"))
    several = units.groupBy("g", "h").agg(F.sum("rows").alias("of")).where("of > 1")
    label = F.pmod("cell", F.lit(shards)).cast("int")
    units = handover(spark, units.join(several, ["g", "h"]).select("g", "h", "cell", label.alias("label"), "rows", "of"), "shard-units")
    state = propagate(spark, units, total, shards, most_turns)
    found = rows.join(state.select("g", "h", "cell", "of", F.col("label").alias("led")), ["g", "h", "cell"], "left")
    linked = F.col("led").isNotNull() & ~F.col("alone")
    found = found.select(
        "rid",
        "row",
        "size",
        "text_crc32",
        F.when(linked, F.col("led")).otherwise(label).alias("label"),
        linked.alias("linked"),
        F.when(linked, F.xxhash64("g", "h")).otherwise(F.xxhash64("rid")).alias("together"),
        F.when(linked, F.col("of")).otherwise(F.lit(1)).alias("of"),
    )
    labelled = handover(spark, found, "shard-labelled")
    settled = handover(spark, _settled(spark, labelled, total, shards), "shard-settled")
    numbered = _ranked(settled, total, shards, "shard", F.lit(0), F.xxhash64("rid"), F.lit(0))
    return numbered.select("row", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
