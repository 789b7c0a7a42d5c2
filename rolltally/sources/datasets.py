"""Reading training and evaluation datasets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolltally.functions.fixed_values import SPLIT_FILE_FORMATS
from rolltally.session import new_path
from rolltally.sources.splitting import json_array_records, read_split_csv

INSTRUCTION_EVAL_SCHEMA = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("instruction_id_list", T.ArrayType(T.StringType())),
        T.StructField("kwargs", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)


def read_dataset(
    spark: SparkSession,
    path: str,
    split: str = "train",
    schema: T.StructType | None = None,
    csv_multi_line: bool = True,
) -> DataFrame:
    """Read a dataset by folder, file or registered name.

    A folder is searched for ``<split>`` as .jsonl, .json, .parquet and .csv, in that
    order. A file is read by its ending. Anything else is a table name, filtered on its
    ``split`` column if it has one. Files may be folders of part files, as Spark writes.
    CSV columns are text unless a schema says otherwise. Files are split among tasks, CSV
    files with line breaks in fields and JSON arrays of objects too; where no field holds a
    line break, ``csv_multi_line=False`` saves looking for them.
    """
    ending = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    formats = dict(SPLIT_FILE_FORMATS)
    if path_exists(spark, path):
        for suffix, fmt in SPLIT_FILE_FORMATS:
            candidate = f"{path.rstrip('/')}/{split}.{suffix}"
            if path_exists(spark, candidate):
                return _read(spark, candidate, fmt, schema, csv_multi_line)
        if ending in formats:
            return _read(spark, path, formats[ending], schema, csv_multi_line)
        raise ValueError(
            f"'{path}' has no file of split '{split}' and no supported ending. "
            f"Supported: {', '.join('.' + suffix for suffix in formats)}."
        )
    table = spark.table(path)
    return table.where(F.col("split") == split) if "split" in table.columns else table


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read on whatever file system it names; runs no job."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _read(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | None, csv_multi_line: bool
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "json" and is_json_array(spark, path):
        objects = json_array_records(spark, path).select("text")
        if schema is not None:
            return objects.select(F.from_json("text", schema).alias("row")).select("row.*")
        # Types are inferred over all objects, which are written one per line for that.
        lines = new_path(spark, "json-lines")
        objects.write.text(lines)
        return spark.read.json(lines)
    if fmt == "json":
        return reader.json(path)
    if fmt == "csv" and csv_multi_line:
        return read_split_csv(spark, path, schema)
    if fmt == "csv":
        return reader.option("header", True).option("escape", '"').csv(path)
    return reader.parquet(path)


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds one array instead of one object per line.

    Only the first character of the first line that is not blank is fetched.
    """
    start = F.substring(F.ltrim(F.col("value")), 1, 1)
    found = spark.read.text(path).select(start.alias("start")).where("start <> ''").take(1)
    return bool(found) and found[0]["start"] == "["


def read_instruction_eval(spark: SparkSession, path: str) -> DataFrame:
    """Read instruction-following prompts from JSON lines."""
    return spark.read.schema(INSTRUCTION_EVAL_SCHEMA).json(path)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet shards of a folder, each row with ``shard`` and ``row_in_shard``.

    The two give the order of the shards by name and of the rows within, which a
    distributed scan does not keep. A folder without shards is an error.
    """
    try:
        files = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    except AnalysisException as error:
        raise FileNotFoundError(f"No parquet files found under: {folder}") from error
    return files.select(
        "*",
        F.col("_metadata.file_path").alias("shard"),
        F.col("_metadata.row_index").alias("row_in_shard"),
    )


def with_global_index(shards: DataFrame, name: str = "row_index") -> DataFrame:
    """Add the position over all shards: rows of earlier shards plus position in the own.

    Needs one light pass that reads no data columns. The offsets have one row per file; how
    they are joined is left to Catalyst, which broadcasts them while they are small.
    """
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    placed = shards.join(offsets, "shard")
    return placed.select(*shards.columns, (F.col("_offset") + F.col("row_in_shard")).alias(name))


def tagged_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
