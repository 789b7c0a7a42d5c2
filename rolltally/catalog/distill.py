"""Token-level divergence, objectives and rollout scores on vectors as logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.functions import logprobs
from rolltally.operators import distill
from rolltally.operators.ordering import moving_average
from rolltally.operators.sampling import union_named
from rolltally.plans.distill_report import distill_report

BETA = 0.3


def log_probs(temperature: float = 1.0, top_k: int | None = None) -> str:
    """SQL: ``lp`` with the log-probabilities of each cell, optionally of the teacher's best."""
    kept = "" if top_k is None else f"QUALIFY row_number() OVER (PARTITION BY ex_id, pos ORDER BY t DESC, token_id) <= {top_k}"
    return f"""WITH {b.LOGITS},
kept AS (SELECT *, s / {temperature} AS ss, t / {temperature} AS tt FROM cells {kept}),
lp AS (
  SELECT ex_id, pos, sampled_id, label, token_id,
         ss - ln(sum(exp(ss)) OVER (PARTITION BY ex_id, pos)) AS s,
         tt - ln(sum(exp(tt)) OVER (PARTITION BY ex_id, pos)) AS t
  FROM kept
)"""


FORWARD = "exp(t) * (t - s)"
REVERSE = "exp(s) * (s - t)"
MIXED = f"""({BETA} * exp(t) * (t - ln({1 - BETA} * exp(s) + {BETA} * exp(t)))
  + {1 - BETA} * exp(s) * (s - ln({1 - BETA} * exp(s) + {BETA} * exp(t))))"""


def divergences(cell: str, source: str = "lp") -> str:
    return f"""SELECT ex_id, pos, round(sum({cell}), 6) AS divergence, CAST(count(*) AS INTEGER) AS num_cells
               FROM {source} GROUP BY ex_id, pos"""


def positions(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = distill.position_divergence(b.logits(spark, sf_dir), **options)
    return rows.select("ex_id", "pos", F.round("divergence", 6).alias("divergence"), "num_cells")


@query(
    "log_softmax",
    log_probs(temperature=0.7)
    + """ SELECT ex_id, pos, round(sum(exp(s)), 6) AS total, round(max(s), 6) AS highest, round(min(s), 6) AS lowest
          FROM lp GROUP BY ex_id, pos""",
)
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.logits(spark, sf_dir).select(
        "ex_id", "pos", logprobs.log_softmax(F.col("student"), 0.7).alias("s")
    )
    total = logprobs.array_sum(F.transform("s", lambda x: F.exp(x)))
    return rows.select(
        "ex_id",
        "pos",
        F.round(total, 6).alias("total"),
        F.round(F.array_max("s"), 6).alias("highest"),
        F.round(F.array_min("s"), 6).alias("lowest"),
    )


@query("forward_kl", log_probs() + divergences(FORWARD))
def forward_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir, beta=0)


@query("reverse_kl", log_probs() + divergences(REVERSE))
def reverse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir, beta=1)


@query("mixed_divergence", log_probs(temperature=2.0) + divergences(MIXED))
def mixed_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir, beta=BETA, temperature=2.0)


@query("top_k_divergence", log_probs(temperature=0.5, top_k=10) + divergences(MIXED))
def top_k_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir, beta=BETA, temperature=0.5, top_k=10)


@query("cell_clipped_divergence", log_probs() + divergences(f"least({FORWARD}, 0.01)"))
def cell_clipped_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir, beta=0, clip=0.01)


@query(
    "token_clipped_divergence",
    log_probs()
    + f""" SELECT ex_id, pos, round(least(sum({FORWARD}), 1.0), 6) AS divergence, CAST(count(*) AS INTEGER) AS num_cells
           FROM lp GROUP BY ex_id, pos""",
)
def token_clipped_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir, beta=0, clip=1.0, clip_level="token")


@query(
    "probability_divergence",
    f"""WITH {b.LOGITS},
        lp AS (SELECT ex_id, pos, ln(greatest(s * s / 100, 1e-8)) AS s, ln(greatest(t * t / 100, 1e-8)) AS t FROM cells)
        {divergences(FORWARD)}""",
)
def probability_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared components as probabilities; temperature and top-k must not matter."""
    table = b.logits(spark, sf_dir)
    squared = table.withColumns(
        {side: F.transform(side, lambda x: x * x / 100) for side in ("student", "teacher")}
    )
    rows = distill.position_divergence(
        squared, beta=0, temperature=3.0, top_k=5, are_probabilities=True
    )
    return rows.select("ex_id", "pos", F.round("divergence", 6).alias("divergence"), "num_cells")


_POSITIONS = (
    log_probs()
    + f""",
per_position AS (
  SELECT ex_id, pos, sampled_id, label, sum({MIXED}) AS divergence, count(*) AS num_cells
  FROM lp GROUP BY ex_id, pos, sampled_id, label
),
scored AS (SELECT * FROM per_position WHERE label <> -100)"""
)


_REDUCTIONS = (
    _POSITIONS
    + """ SELECT 'batchmean' AS reduction, ex_id % 4 AS batch, round(sum(divergence) / count(*), 6) AS loss,
                 count(*) AS num_tokens FROM scored GROUP BY 2
          UNION ALL SELECT 'sum', ex_id % 4, round(sum(divergence), 6), count(*) FROM scored GROUP BY 2
          UNION ALL SELECT 'mean', ex_id % 4, round(sum(divergence) / sum(num_cells), 6), count(*) FROM scored GROUP BY 2
          UNION ALL SELECT 'per example', ex_id % 4, round(sum(divergence) / count(DISTINCT ex_id), 6), count(*)
            FROM per_position GROUP BY 2"""
)


@query("divergence_reductions", _REDUCTIONS)
def divergence_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distill.position_divergence(b.logits(spark, sf_dir), beta=BETA).drop("student", "teacher")
    rows = rows.withColumn("batch", F.pmod("ex_id", F.lit(4)))
    return distill.reduce_divergence_all_ways(rows, ["batch"]).withColumn("loss", F.round("loss", 6))


@query("divergence_losses", _REDUCTIONS)
def divergence_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers from the compiled sum over cells."""
    rows = b.logits(spark, sf_dir).withColumn("batch", F.pmod("ex_id", F.lit(4)))
    return distill.divergence_losses(rows, ["batch"], beta=BETA).withColumn("loss", F.round("loss", 6))


@query(
    "unreduced_divergence",
    _POSITIONS + " SELECT ex_id, pos, round(divergence, 6) AS divergence FROM scored",
)
def unreduced_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distill.position_divergence(b.logits(spark, sf_dir), beta=BETA)
    kept = distill.reduce_divergence(rows, reduction="none")
    return kept.select("ex_id", "pos", F.round("divergence", 6).alias("divergence"))


_SAMPLED = (
    log_probs()
    + """,
sampled AS (
  SELECT ex_id, pos, label, s AS student_log_prob, t AS teacher_log_prob FROM lp WHERE token_id = sampled_id
)"""
)


@query(
    "sampled_log_probs",
    _SAMPLED
    + """ SELECT ex_id, pos, round(student_log_prob, 6) AS student_log_prob,
                 round(teacher_log_prob, 6) AS teacher_log_prob FROM sampled""",
)
def sampled_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distill.sampled_log_probs(b.logits(spark, sf_dir))
    return rows.select(
        "ex_id",
        "pos",
        F.round("student_log_prob", 6).alias("student_log_prob"),
        F.round("teacher_log_prob", 6).alias("teacher_log_prob"),
    )


@query(
    "rollout_scores",
    _SAMPLED
    + """ SELECT ex_id,
                 round(coalesce(sum(teacher_log_prob) FILTER (label <> -100), 0) / greatest(count(*) FILTER (label <> -100), 1), 6) AS teacher_reward,
                 round(coalesce(sum(student_log_prob) FILTER (label <> -100), 0) / greatest(count(*) FILTER (label <> -100), 1), 6) AS student_score,
                 CAST(greatest(count(*) FILTER (label <> -100), 1) AS INTEGER) AS num_completion_tokens,
                 round(coalesce(sum(teacher_log_prob - student_log_prob) FILTER (label <> -100), 0)
                       / greatest(count(*) FILTER (label <> -100), 1), 6) AS reward_advantage
          FROM sampled GROUP BY ex_id""",
)
def rollout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = distill.rollout_scores(distill.sampled_log_probs(b.logits(spark, sf_dir)), ["ex_id"])
    return scores.withColumns(
        {c: F.round(c, 6) for c in ("teacher_reward", "student_score", "reward_advantage")}
    )


@query(
    "sampled_token_objective",
    _SAMPLED
    + """ SELECT ex_id % 4 AS batch, round(-avg((teacher_log_prob - student_log_prob) * student_log_prob), 6) AS loss,
                 round(avg(teacher_log_prob - student_log_prob), 6) AS mean_advantage, count(*) AS num_tokens
          FROM sampled WHERE label <> -100 GROUP BY 1""",
)
def sampled_token_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = distill.sampled_log_probs(b.logits(spark, sf_dir))
    batched = sampled.withColumn("batch", F.pmod("ex_id", F.lit(4)))
    losses = distill.sampled_token_objective(batched, ["batch"])
    return losses.withColumns({c: F.round(c, 6) for c in ("loss", "mean_advantage")})


@query(
    "distill_report",
    f"""{log_probs(top_k=16)},
        clipped AS (SELECT sum(least({MIXED}, 0.05)) AS divergence FROM lp WHERE label <> -100 GROUP BY ex_id, pos),
        everything AS (
          SELECT ex_id, pos, label, token_id = sampled_id AS is_sampled,
                 s - ln(sum(exp(s)) OVER (PARTITION BY ex_id, pos)) AS s,
                 t - ln(sum(exp(t)) OVER (PARTITION BY ex_id, pos)) AS t
          FROM cells)
        SELECT 'vocabulary' AS objective, round(sum(divergence) / count(*), 6) AS loss, count(*) AS num_tokens
        FROM clipped
        UNION ALL SELECT 'sampled', round(-avg((t - s) * s), 6), count(*) FROM everything
        WHERE is_sampled AND label <> -100""",
)
def distill_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both objectives; a clip or top-k of zero would switch the feature off."""
    table = b.logits(spark, sf_dir)
    reports = {
        "vocabulary": distill_report(table, beta=BETA, top_k=16, clip=0.05),
        "sampled": distill_report(table, sampled_tokens_only=True, top_k=0, clip=0.0),
    }
    return union_named(reports, "objective").withColumn("loss", F.round("loss", 6))


@query(
    "divergence_by_token",
    _POSITIONS
    + """ SELECT sampled_id, round(avg(divergence), 6) AS mean_divergence, count(*) AS num_tokens,
                 any_value(r_name) AS token_class
          FROM per_position LEFT JOIN nation ON n_nationkey = sampled_id LEFT JOIN region ON r_regionkey = n_regionkey
          GROUP BY sampled_id""",
)
def divergence_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tokens, regions as their classes."""
    rows = distill.position_divergence(b.logits(spark, sf_dir), beta=BETA)
    regions = b.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("token_class")
    )
    classes = (
        b.table(spark, sf_dir, "nation")
        .join(regions, "n_regionkey")
        .select(F.col("n_nationkey").cast("int").alias("sampled_id"), "token_class")
    )
    return distill.divergence_by_token(rows, classes).withColumn(
        "mean_divergence", F.round("mean_divergence", 6)
    )


_TOP = f"""WITH {b.LOGITS},
top AS (
  SELECT ex_id, pos, token_id, s, t,
         row_number() OVER (PARTITION BY ex_id, pos ORDER BY t DESC, token_id) AS rank
  FROM cells QUALIFY rank <= 5
)"""


@query(
    "teacher_top_k_tokens",
    _TOP
    + """ SELECT ex_id, pos, CAST(rank AS INTEGER) AS rank, CAST(token_id AS INTEGER) AS token_id,
                 round(s, 6) AS student_logit, round(t, 6) AS teacher_logit FROM top""",
)
def teacher_top_k_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = distill.top_k_tokens(b.logits(spark, sf_dir), 5).drop("sampled_id", "label")
    return top.withColumns({c: F.round(c, 6) for c in ("student_logit", "teacher_logit")})


@query(
    "student_logits_at_teacher_top_k",
    _TOP + " SELECT ex_id, pos, CAST(token_id AS INTEGER) AS token_id, round(s, 6) AS logit FROM top",
)
def student_logits_at_teacher_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student logits at the teacher's choice, gathered inside the row."""
    wanted = logprobs.keep_top_k(F.col("student"), F.col("teacher"), 5)["token_id"]
    rows = b.logits(spark, sf_dir).select("ex_id", "pos", "student", wanted.alias("wanted"))
    gathered = rows.select("ex_id", "pos", F.inline(distill.gather_in_row(F.col("student"), F.col("wanted"))))
    return gathered.withColumn("logit", F.round("logit", 6))


@query(
    "moving_average",
    """SELECT user_id, event_id,
              round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY event_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                lambda a, x: 1 / 3 * a + (1 - 1 / 3) * x), 6) AS ema
       FROM events""",
)
def moving_average_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decay that makes blocks of 73 rows, so that values are handed over between them."""
    events = b.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    averaged = moving_average(events, ["user_id"], "event_id", "value", decay=1 / 3, block_rows=5000)
    return averaged.select("user_id", "event_id", F.round("ema", 6).alias("ema"))
