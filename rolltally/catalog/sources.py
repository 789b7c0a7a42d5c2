"""Readers, adapters, sinks and layout, each going through files where files matter."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.operators.benchmarks import choice_metrics
from rolltally.operators.grading import problem_results, run_metrics
from rolltally.plans.benchmark_eval import choice_benchmark, write_scores
from rolltally.plans.conversion import convert_shards
from rolltally.plans.math_eval import evaluate_math, write_evaluation
from rolltally.session import new_path
from rolltally.sources import benchmarks, datasets, layout, sinks

_PAIRS = f"WITH {b.TURN_PAIRS} SELECT problem, solution FROM pairs"


@query("read_jsonl_folder", _PAIRS)
def read_jsonl_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with .jsonl and .parquet of the same split: .jsonl comes first."""
    folder = new_path(spark, "dataset")
    pairs = b.turn_pairs(spark, sf_dir).select("problem", "solution")
    sinks.write_jsonl(pairs, f"{folder}/train.jsonl")
    pairs.select(F.lit("wrong").alias("problem")).write.parquet(f"{folder}/train.parquet")
    return datasets.read_dataset(spark, folder, "train")


@query("read_parquet_folder", _PAIRS)
def read_parquet_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "dataset")
    b.turn_pairs(spark, sf_dir).select("problem", "solution").write.parquet(f"{folder}/test.parquet")
    return datasets.read_dataset(spark, folder, "test")


@query("read_csv_file", _PAIRS)
def read_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes in a .csv file."""
    path = new_path(spark, "dataset") + ".csv"
    pairs = b.turn_pairs(spark, sf_dir).select("problem", "solution")
    pairs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return datasets.read_dataset(spark, path)


@query("read_parquet_file", "SELECT item_id, text FROM benchmark")
def read_parquet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.read_dataset(spark, f"{sf_dir}/benchmark.parquet")


@query("read_registered_table", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def read_registered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered dataset, of which one split is read."""
    documents = b.table(spark, sf_dir, "documents")
    name = f"documents_{uuid4().hex}"
    documents.withColumn("split", F.col("lang")).createOrReplaceTempView(name)
    return datasets.read_dataset(spark, name, "en").select("doc_id", "lang")


@query("shard_scan", "SELECT doc_id, doc_id AS row_index, length(text) AS num_chars FROM documents")
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written from ranges of documents, in name order, indexed over all of them."""
    folder = new_path(spark, "shards")
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(folder)
    indexed = datasets.with_global_index(datasets.read_shards(spark, folder))
    return indexed.select("doc_id", "row_index", F.length("text").cast("long").alias("num_chars"))


@query(
    "instruction_eval_read",
    """SELECT doc_id AS key, text AS prompt, 'length,language' AS instructions, lang AS language,
              CAST(n_chars AS VARCHAR) AS max_length FROM documents""",
)
def instruction_eval_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "prompts")
    prompts = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.col("text").alias("prompt"),
        F.array(F.lit("length"), F.lit("language")).alias("instruction_id_list"),
        F.array(
            F.create_map(F.lit("max"), F.col("n_chars").cast("string")),
            F.create_map(F.lit("lang"), F.col("lang")),
        ).alias("kwargs"),
    )
    sinks.write_jsonl(prompts, path)
    stored = datasets.read_instruction_eval(spark, path)
    return stored.select(
        "key",
        "prompt",
        F.array_join("instruction_id_list", ",").alias("instructions"),
        F.get("kwargs", F.lit(1))["lang"].alias("language"),
        F.get("kwargs", F.lit(0))["max"].alias("max_length"),
    )


@query(
    "benchmark_adapters",
    r"""SELECT 'amo-bench' AS benchmark, CAST(o_orderkey AS VARCHAR) AS question_id, o_orderpriority AS problem,
               o_orderstatus AS gt_answer FROM orders
        UNION ALL SELECT 'aime24', CAST(item_id AS VARCHAR), text, CAST(length(text) AS VARCHAR) FROM benchmark
        UNION ALL SELECT 'minerva', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part
        UNION ALL SELECT 'amc23', NULL, p_type, CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT 'aime25', CAST(doc_id AS VARCHAR), text, CAST(n_chars AS VARCHAR) FROM documents
        UNION ALL SELECT 'hmmt25', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR) FROM customer
        UNION ALL SELECT 'math500', NULL, s_name, CASE WHEN s_suppkey % 2 = 0 THEN '\frac{' || CAST(s_suppkey AS VARCHAR)
                  || '}{2}' ELSE s_name || ' has no box' END FROM supplier""",
)
def benchmark_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table takes the columns of one published benchmark."""

    def renamed(name: str, **columns) -> DataFrame:
        return b.table(spark, sf_dir, name).select(
            *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()]
        )

    boxed = F.concat(F.lit("\\boxed{1} so \\boxed{\\frac{"), F.col("s_suppkey").cast("string"), F.lit("}{2}}."))
    solution = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, boxed).otherwise(
        F.concat("s_name", F.lit(" has no box"))
    )
    return benchmarks.union_benchmarks(
        {
            "amo-bench": renamed("orders", prompt="o_orderpriority", answer="o_orderstatus", question_id="o_orderkey"),
            "AIME24": renamed("benchmark", problem="text", answer=F.length("text"), id="item_id"),
            "minerva": renamed("part", question="p_name", answer="p_brand", id="p_partkey"),
            "amc23": renamed("part", question="p_type", answer="p_size"),
            "aime25": renamed("documents", problem="text", answer="n_chars", problem_idx="doc_id"),
            "hmmt25": renamed("customer", problem="c_name", answer="c_nationkey", problem_idx="c_custkey"),
            "math500": renamed("supplier", problem="s_name", solution=solution),
        }
    )


@query(
    "jsonl_sink",
    "SELECT doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, unescaped and with explicit nulls, written and read back."""
    path = new_path(spark, "lines")
    joined = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    sinks.write_jsonl(joined.select("doc_id", "text", "quality"), path)
    return spark.read.schema("doc_id long, text string, quality int").json(path)


@query(
    "jsonl_null_fields",
    """SELECT quality IS NULL AS unlabelled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def jsonl_null_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are spelled out in the file."""
    path = new_path(spark, "lines")
    joined = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    sinks.write_jsonl(joined.select("doc_id", "quality"), path)
    lines = spark.read.text(path)
    return lines.groupBy(F.col("value").contains('"quality":null').alias("unlabelled")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "run_summary",
    f"""WITH {b.PROBLEMS}
        SELECT 'model' AS base_model, 'events' AS dataset, 1.0::DOUBLE AS temperature, {b.VAL_N} AS val_n,
               count(*) AS num_problems, count(*) FILTER (has_correct) AS pass_at_n,
               CAST(sum(num_correct) AS BIGINT) AS average_at_n,
               round(sum(num_correct) / (count(*) * {b.VAL_N}) * 100, 6) AS average_at_n_pct
        FROM problems""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of settings and metrics, written and read back."""
    path = new_path(spark, "summary")
    metrics = run_metrics(problem_results(b.samples(spark, sf_dir), expressions=False), b.VAL_N, by=[])
    config = {"base_model": "model", "dataset": "events", "temperature": 1.0, "val_n": b.VAL_N}
    sinks.write_summary(sinks.summary_row(metrics, config), path)
    schema = """base_model string, dataset string, temperature double, val_n int, num_problems long, pass_at_n long,
                average_at_n long, average_at_n_pct double"""
    stored = spark.read.schema(schema).json(path)
    return stored.withColumn("average_at_n_pct", F.round("average_at_n_pct", 6))


@query(
    "written_evaluation",
    f"""WITH {b.SAMPLES}
        SELECT run, problem_id, CAST(sample_idx // 256 AS INTEGER) AS part, count(*) AS num_generations,
               string_agg(shown, '|' ORDER BY sample_idx) AS predicted_answers, {b.VAL_N} AS val_n
        FROM samples GROUP BY run, problem_id, part""",
)
def written_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detailed results beside the summary, read back from the files."""
    path = new_path(spark, "evaluation")
    write_evaluation(evaluate_math(b.samples(spark, sf_dir), b.VAL_N, expressions=False), path, {"dataset": "events"})
    schema = """run string, problem_id long, part int, val_n int, generations array<struct<predicted_answer: string,
                full_generation: string, correct: boolean, formatted: boolean>>"""
    stored = spark.read.schema(schema).json(f"{path}/results")
    return stored.select(
        "run",
        "problem_id",
        "part",
        "val_n",
        F.size("generations").cast("long").alias("num_generations"),
        F.array_join("generations.predicted_answer", "|").alias("predicted_answers"),
    )


@query(
    "results_log",
    f"""WITH {b.SAMPLES}
        SELECT run, count(*) AS num_samples, round(avg(CAST(is_formatted AS DOUBLE)), 6) AS format_rate
        FROM samples GROUP BY run""",
)
def results_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all runs appended to one log."""
    path = new_path(spark, "log")
    results = problem_results(b.samples(spark, sf_dir), expressions=False)
    sinks.append_summary(results, None)
    # All runs are summed up in one pass; each appends its own line.
    summaries = results.groupBy("run").agg(
        F.sum("num_samples").alias("num_samples"),
        F.round(F.sum("num_formatted") / F.sum("num_samples"), 6).alias("format_rate"),
    )
    sinks.append_summary(summaries, path)
    return spark.read.schema("run string, num_samples long, format_rate double").json(path)


@query(
    "output_tags",
    """SELECT c_custkey,
              'eval_results_' || lower(c_mktsegment) || '_' || c_name || CASE WHEN c_custkey % 3 > 0
                THEN '_run' || CAST(c_nationkey AS VARCHAR) || '_checkpoint-' || CAST(c_custkey AS VARCHAR) ELSE '' END ||
              CASE WHEN c_custkey % 2 = 0 THEN '_thinking' ELSE '_nonthinking' END || '_temp' ||
              CASE c_custkey % 2 WHEN 0 THEN '0.6' ELSE '1.0' END || '_valn' || CAST(c_nationkey AS VARCHAR) AS eval_tag,
              'eval_step_' || CASE WHEN c_custkey * 1000 < 100000 THEN lpad(CAST(c_custkey * 1000 AS VARCHAR), 6, '0')
                                   ELSE CAST(c_custkey * 1000 AS VARCHAR) END AS step_tag,
              c_name || CASE WHEN c_custkey % 3 > 0 THEN '+checkpoint-' || CAST(c_custkey AS VARCHAR) ELSE '' END
                AS model_label
       FROM customer""",
)
def output_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    checkpoint = F.when(
        F.pmod(key, F.lit(3)) > 0,
        F.concat(F.lit("/out/run"), nation, F.lit("/checkpoint-"), key.cast("string"), F.lit("/")),
    )
    thinking = F.pmod(key, F.lit(2)) == 0
    model = F.concat(F.lit("/models/"), "c_name")
    tag = layout.eval_tag(
        F.lower("c_mktsegment"),
        model,
        checkpoint,
        thinking,
        F.when(thinking, F.lit(0.6)).otherwise(F.lit(1.0)),
        F.col("c_nationkey"),
    )
    return b.table(spark, sf_dir, "customer").select(
        "c_custkey",
        tag.alias("eval_tag"),
        layout.step_tag(F.lit("eval"), key * 1000).alias("step_tag"),
        layout.model_label(model, checkpoint).alias("model_label"),
    )


@query(
    "instruction_tags",
    """SELECT event_id, 'ifeval_test_' || event_type || '_gpu' || CASE WHEN user_id % 2 = 0 THEN '01' ELSE 'auto' END ||
              '_' || strftime(ts, '%Y-%m-%d_%H%M%S') AS tag, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS generated_at_utc
       FROM events""",
)
def instruction_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = layout.instruction_tag(
        F.lit("test"),
        F.concat(F.lit("/ckpt/"), "event_type"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit("0,1")).otherwise(F.lit("")),
        F.col("ts"),
    )
    stamp = layout.utc_stamp(F.col("ts"))
    return b.table(spark, sf_dir, "events").select(
        "event_id", tag.alias("tag"), stamp.alias("generated_at_utc")
    )


@query(
    "partitioned_layout",
    f"""WITH {b.SAMPLES}
        SELECT run, CAST(problem_id % 3 AS INTEGER) AS step, count(*) AS num_samples FROM samples GROUP BY ALL""",
)
def partitioned_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results partitioned by run and step; the folders are the layout."""
    path = new_path(spark, "layout")
    samples = b.samples(spark, sf_dir).withColumn("step", F.pmod("problem_id", F.lit(3)).cast("int"))
    samples.hint("rebalance", "run", "step").write.partitionBy("run", "step").parquet(path)
    return spark.read.parquet(path).groupBy("run", "step").agg(F.count(F.lit(1)).alias("num_samples"))


@query(
    "shard_conversion",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, 'option ' || CAST(conv_id AS VARCHAR) AS answer, 2 AS num_messages FROM pairs""",
)
def shard_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: shards in, JSON lines with an answer out, counts on the way."""
    base = new_path(spark, "conversion")
    told = F.concat("solution", F.lit("\n**Answer:** option "), F.col("conv_id").cast("string"), F.lit("."))
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.col("problem").alias("content")),
        F.struct(F.lit("assistant").alias("role"), told.alias("content")),
    )
    pairs = b.turn_pairs(spark, sf_dir).select("conv_id", "turn", messages.alias("messages"))
    pairs.write.parquet(f"{base}/shards")
    counts = convert_shards(spark, f"{base}/shards", f"{base}/lines")
    if counts["missing_rows"]:
        raise ValueError(f"Rows without an answer: {counts}")
    schema = "conv_id long, turn long, answer string, messages array<struct<role: string, content: string>>"
    return spark.read.schema(schema).json(f"{base}/lines").select(
        "conv_id", "turn", "answer", F.size("messages").alias("num_messages")
    )


@query(
    "written_choice_scores",
    f"""WITH {b.CHOICES}, counted AS (
          SELECT count(*) AS num_prompts, count(*) FILTER (predicted_answer = gold_answer) AS num_correct FROM scored)
        SELECT 'responses' AS source, num_prompts, num_correct FROM counted
        UNION ALL SELECT 'summary of step 12', num_prompts, num_correct FROM counted""",
)
def written_choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows and summary of one evaluation, read back from their files."""
    scored = choice_benchmark(b.choice_examples(spark, sf_dir), b.choice_responses(spark, sf_dir))
    folder = new_path(spark, "scores")
    base = write_scores({"responses": scored}, choice_metrics(scored), folder, "eval", 12)
    summary = spark.read.schema("step int, eval_mc_accuracy double, eval_mc_num_prompts long").json(
        f"{base}/summary.json"
    )
    told = summary.select(
        F.concat(F.lit("summary of step "), F.col("step").cast("string")).alias("source"),
        F.col("eval_mc_num_prompts").alias("num_prompts"),
        F.round(F.col("eval_mc_accuracy") * F.col("eval_mc_num_prompts")).cast("long").alias("num_correct"),
    )
    rows = spark.read.schema("is_correct boolean").json(f"{base}/responses.jsonl")
    counted = rows.agg(
        F.lit("responses").alias("source"),
        F.count(F.lit(1)).alias("num_prompts"),
        F.count_if("is_correct").alias("num_correct"),
    )
    return counted.unionByName(told)
