"""Token counts of the documents in flat token files that have no index.

A flat file is nothing but ids of a fixed width, a separator id behind each document. Tasks
read blocks of a file and look for separators with array operations; a prefix scan over the
blocks' summaries (how many separators, where the last one is) then says which document a
block begins in and where that document started, so documents of any length are counted
over any number of blocks.

Defined results: an empty document between two separators has 0 tokens; what follows the last
separator is a document that is not ``closed``; a file without ids has no documents; a length
that is no multiple of the width raises an error.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolltally.llm.common import SharedFiles, handover, named
from rolltally.llm.encoding import encoder
from rolltally.session import new_path

BLOCK_BYTES = 4 << 20


def write_flat(spark: SparkSession, docs: DataFrame, tokenizer: str, separator: int) -> tuple[str, DataFrame]:
    """Write a flat file per partition; returns the folder and what was written where.

    The table has ``file``, ``ordinal`` and ``doc_id``. Special markers inside texts are
    encoded as text, so the separator occurs nowhere else. Null texts are empty documents.
    Files of attempts that did not finish are not in the table.
    """
    folder = new_path(spark, "flat-tokens")
    SharedFiles(folder).make()

    def write(batches):
        stream, name, n = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            code = encoder(tokenizer, literal_markers=True)
            if stream is None:
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid4().hex}.bin"
                stream = SharedFiles(folder).create(name)
            end = np.array([separator], dtype=code.kind).tobytes()
            for first in range(0, len(batch), 64):
                for ids in code.encode(batch.column(1).slice(first, 64).to_pylist()):
                    stream.write(ids.tobytes() + end)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(batch)), pa.array(np.arange(n, n + len(batch))), batch.column(0)], names=["file", "ordinal", "doc_id"]
            )
            n += len(batch)
        if stream is not None:
            stream.close()

    source = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text"))
    return folder, handover(spark, source.mapInArrow(write, "file string, ordinal long, doc_id long"), "flat-documents")


def token_counts(spark: SparkSession, folder: str, files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``ordinal``, ``start``, ``n_tokens`` and ``closed`` of every document.

    ``files`` has the names in ``file``; ``start`` is the position of the first token in the
    file; separators are not counted.
    """
    kind = np.dtype(f"<u{width}")
    step = max(1, block_bytes // width) * width

    def sizes(batches):
        shared = SharedFiles(folder)
        for batch in batches:
            found = [shared.size(f) for f in batch.column(0).to_pylist()]
            if any(n % width for n in found):
                raise ValueError(f"The length of a flat token file is a multiple of {width}.")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["file", "bytes"])

    def scan(batches):
        shared = SharedFiles(folder)
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with shared.open(file) as stream:
                    stream.seek(at)
                    ids = np.frombuffer(stream.read(step), dtype=kind)
                found = np.flatnonzero(ids == separator) + at // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([at]), pa.array([len(ids)]), pa.array([len(found)]), pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([found])],
                    names=["file", "at", "n_ids", "n_found", "last_found", "found"],
                )

    known = files.select("file").distinct().mapInArrow(sizes, "file string, bytes long").where("bytes > 0")
    blocks = known.select("file", F.explode(F.expr(f"sequence(0L, bytes - 1, {step}L)")).alias("at")).repartition("file", "at")
    scanned = handover(spark, blocks.mapInArrow(scan, "file string, at long, n_ids long, n_found long, last_found long, found array<long>"), "separators")
    # The prefix scan moves five numbers per block.
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "at", F.coalesce(F.sum("n_found").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last_found").over(before), F.lit(-1)).alias("open_since"))
    each = scanned.join(carried, ["file", "at"]).select("file", "base", F.array_append(F.array_prepend("found", F.col("open_since")), F.lit(None).cast("long")).alias("edges"), F.size("found").alias("n"))
    closed = each.where("n > 0").select("file", "base", F.expr("inline(transform(sequence(1, n), i -> named_struct('i', i, 'low', edges[i - 1] + 1, 'high', edges[i])))"))
    ended = closed.select("file", (F.col("base") + F.col("i") - 1).alias("ordinal"), F.col("low").alias("start"), (F.col("high") - F.col("low")).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = scanned.groupBy("file").agg(F.sum("n_found").alias("ordinal"), F.sum("n_ids").alias("ids"), F.coalesce(F.max("last_found") + 1, F.lit(0)).alias("start"))
    rest = totals.where("ids > start").select("file", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return ended.unionByName(rest)
