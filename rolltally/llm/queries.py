"""Queries ``opN_<name>``: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm import alignment, decontaminate, lines, packing, quality, sharding, simhash, substrings, tokencounts, tokenfiles, toxicity, variants, warc
from rolltally.llm.common import handover, reach_workers
from rolltally.llm.oracles import ORACLES  # noqa: F401  (read by the entry point)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# The id of <|endoftext|>; special markers inside texts are encoded as text.
SEPARATOR_ID = 49407


# The tokenizers that the alignment compares.
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
# One in so many words of a document loses a letter in the query on spelling.
SPOILED = 199


def tokenizer_path(name: str) -> str:
    """Place of a tokenizer's file; only the queries that encode need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("item_ids"),
        F.array_min("matches.distance").alias("least_distance"),
    )


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    # A null id is none of those held out.
    fold = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(1))
    model = toxicity.fit(spark, docs, labels.where(fold(labels["doc_id"]) != 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(spark, _table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_packed(spark, _table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), END_ID)
    return tokenfiles.read_packed(files, digest=True)


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(spark, _table(spark, sf_dir, "documents"), words_an_edit=lines.WORDS_AN_EDIT)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_links", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(spark, _table(spark, sf_dir, "pages"))
    records = warc.read_warc(files, keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_filter(spark, _table(spark, sf_dir, "documents"), tail=quality.TAIL)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, written = tokencounts.write_flat(spark, _table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), SEPARATOR_ID)
    counts = handover(spark, tokencounts.token_counts(spark, folder, written, SEPARATOR_ID), "token-counts")
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    placed = packing.best_fit(docs, packing.word_length(docs["text"]) + 1, packing.text_cluster(docs["text"]))
    return placed.select("doc_id", "piece", "start", "length", "group", "bin", "slot", "offset")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.variants_of(spark, _table(spark, sf_dir, "documents"), spoil_one_in=SPOILED)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.align(spark, docs, tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.balanced_shards(spark, _table(spark, sf_dir, "documents"))
    return dealt.select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
