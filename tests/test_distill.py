import numpy as np
import pytest
from pyspark.sql import functions as F

from rolltally.operators import distill
from rolltally.plans.distill_report import distill_report

RNG = np.random.default_rng(5)
VOCAB, EXAMPLES, LENGTH = 11, 3, 4


@pytest.fixture(scope="module")
def cube():
    student = RNG.normal(size=(EXAMPLES, LENGTH, VOCAB)) * 3
    teacher = RNG.normal(size=(EXAMPLES, LENGTH, VOCAB)) * 3
    sampled = RNG.integers(0, VOCAB, size=(EXAMPLES, LENGTH))
    labels = np.where(RNG.random((EXAMPLES, LENGTH)) < 0.3, -100, sampled)
    labels[2] = -100
    return student, teacher, sampled, labels


@pytest.fixture(scope="module")
def table(spark, cube):
    student, teacher, sampled, labels = cube
    rows = [
        (e, p, int(sampled[e, p]), int(labels[e, p]), student[e, p].tolist(), teacher[e, p].tolist())
        for e in range(EXAMPLES)
        for p in range(LENGTH)
    ]
    schema = "ex_id long, pos int, sampled_id int, label int, student array<double>, teacher array<double>"
    return spark.createDataFrame(rows, schema)


def log_softmax(x):
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def cells(student, teacher, beta, temperature=1.0, top_k=None, clip=None):
    student, teacher = student / temperature, teacher / temperature
    if top_k:
        best = np.argsort(-teacher, axis=-1, kind="stable")[..., :top_k]
        student, teacher = np.take_along_axis(student, best, -1), np.take_along_axis(teacher, best, -1)
    s, t = log_softmax(student), log_softmax(teacher)
    if beta == 0:
        out = np.exp(t) * (t - s)
    elif beta == 1:
        out = np.exp(s) * (s - t)
    else:
        m = np.log((1 - beta) * np.exp(s) + beta * np.exp(t))
        out = beta * np.exp(t) * (t - m) + (1 - beta) * np.exp(s) * (s - m)
    return out if clip is None else np.minimum(out, clip)


def per_position(df):
    return np.array([r["divergence"] for r in df.orderBy("ex_id", "pos").collect()]).reshape(EXAMPLES, LENGTH)


@pytest.mark.parametrize(
    "options",
    [
        {"beta": 0},
        {"beta": 1},
        {"beta": 0.5},
        {"beta": 0.2, "temperature": 1.7},
        {"beta": 0.5, "top_k": 4},
        {"beta": 0, "clip": 0.05},
        {"beta": 0.7, "top_k": 3, "clip": 0.02, "temperature": 0.6},
    ],
)
def test_divergence_matches_numpy(table, cube, options):
    got = per_position(distill.position_divergence(table, **options))
    np.testing.assert_allclose(got, cells(cube[0], cube[1], **options).sum(-1), rtol=1e-10, atol=1e-12)


def test_clip_levels_differ(table, cube):
    by_token = per_position(distill.position_divergence(table, beta=0, clip=0.4, clip_level="token"))
    np.testing.assert_allclose(by_token, np.minimum(cells(cube[0], cube[1], 0).sum(-1), 0.4))
    with pytest.raises(ValueError, match="clip_level"):
        distill.position_divergence(table, clip_level="row")


def test_symmetry_and_sign(table):
    swapped = table.select("ex_id", "pos", F.col("student").alias("teacher"), F.col("teacher").alias("student"))
    forward = per_position(distill.position_divergence(table, beta=0))
    np.testing.assert_allclose(forward, per_position(distill.position_divergence(swapped, beta=1)))
    mixed = per_position(distill.position_divergence(table, beta=0.3))
    np.testing.assert_allclose(mixed, per_position(distill.position_divergence(swapped, beta=0.7)))
    assert (forward >= 0).all() and (mixed >= 0).all()


def test_top_k_of_whole_vocabulary_changes_nothing(table):
    whole = per_position(distill.position_divergence(table, beta=0.5))
    np.testing.assert_allclose(whole, per_position(distill.position_divergence(table, beta=0.5, top_k=VOCAB)))


def test_zero_switches_off(table):
    plain = per_position(distill.position_divergence(table, beta=0.5))
    np.testing.assert_allclose(plain, per_position(distill.position_divergence(table, beta=0.5, top_k=0, clip=0)))


def test_probabilities_ignore_temperature_and_top_k(spark):
    row = [(0, 0, [0.5, 0.5, 0.0], [0.9, 0.0, 0.1])]
    df = spark.createDataFrame(row, "ex_id long, pos int, student array<double>, teacher array<double>")
    got = distill.position_divergence(df, beta=0, temperature=9.0, top_k=1, are_probabilities=True).first()
    s, t = np.log([0.5, 0.5, 1e-8]), np.log([0.9, 1e-8, 0.1])
    assert got["num_cells"] == 3
    assert got["divergence"] == pytest.approx((np.exp(t) * (t - s)).sum())


def test_huge_logits_stay_finite(spark):
    df = spark.createDataFrame(
        [(0, 0, [1000.0, 0.0], [0.0, 1000.0])], "ex_id long, pos int, student array<double>, teacher array<double>"
    )
    for beta in (0, 0.5, 1):
        assert np.isfinite(distill.position_divergence(df, beta=beta).first()["divergence"])


def test_reductions(table, cube):
    student, teacher, _, labels = cube
    c = cells(student, teacher, 0.5)
    keep = labels != -100
    rows = distill.position_divergence(table, beta=0.5)

    def loss(**options):
        return distill.reduce_divergence(rows, **options).first()["loss"]

    assert loss(reduction="batchmean") == pytest.approx(c[keep].sum() / keep.sum())
    assert loss(reduction="sum") == pytest.approx(c[keep].sum())
    assert loss(reduction="mean") == pytest.approx(c[keep].mean())
    assert loss(reduction="batchmean", label=None) == pytest.approx(c.sum() / EXAMPLES)
    assert distill.reduce_divergence(rows, reduction="none").count() == keep.sum()
    with pytest.raises(ValueError, match="Unknown reduction"):
        distill.reduce_divergence(rows, reduction="max")


@pytest.mark.parametrize("reduction", ["batchmean", "sum", "mean"])
@pytest.mark.parametrize("label", ["label", None])
@pytest.mark.parametrize(
    "options",
    [{"beta": 0}, {"beta": 0.4, "temperature": 1.5, "clip": 0.03}, {"beta": 1, "top_k": 4}, {"top_k": 0, "clip": 0.0}],
)
def test_both_ways_to_the_loss_agree(table, reduction, label, options):
    halves = table.withColumn("half", F.col("pos") % 2)
    slow = distill.reduce_divergence(
        distill.position_divergence(halves, **options), ["half"], reduction, label
    )
    fast = distill.divergence_loss(halves, ["half"], reduction=reduction, label=label, **options)
    one = {r["half"]: (r["loss"], r["num_tokens"]) for r in slow.collect()}
    two = {r["half"]: (r["loss"], r["num_tokens"]) for r in fast.collect()}
    assert one.keys() == two.keys()
    for half in one:
        assert one[half][0] == pytest.approx(two[half][0], rel=1e-9)
        assert one[half][1] == two[half][1]


def test_loss_of_nothing(table):
    nothing = distill.divergence_loss(table.where("label = -100"), reduction="sum").first()
    assert tuple(nothing) == (0.0, 0)
    with pytest.raises(ValueError, match="reductions"):
        distill.divergence_loss(table, reduction="none")


def test_kept_cells(table, cube):
    row = distill.position_divergence(table.where("ex_id = 0 and pos = 0"), beta=0, keep_cells=True).first()
    np.testing.assert_allclose(row["cells"], cells(cube[0], cube[1], 0)[0, 0])


def test_rollout_scores_and_objective(table, cube):
    student, teacher, sampled, labels = cube
    s = np.take_along_axis(log_softmax(student / 1.3), sampled[..., None], -1)[..., 0]
    t = np.take_along_axis(log_softmax(teacher / 1.3), sampled[..., None], -1)[..., 0]
    keep = labels != -100
    rows = distill.sampled_log_probs(table, temperature=1.3)
    assert "student" not in rows.columns
    scores = {r["ex_id"]: r for r in distill.rollout_scores(rows, ["ex_id"]).collect()}
    for e in range(EXAMPLES):
        count = max(keep[e].sum(), 1)
        assert scores[e]["num_completion_tokens"] == count
        assert scores[e]["teacher_reward"] == pytest.approx(t[e][keep[e]].sum() / count)
        assert scores[e]["student_score"] == pytest.approx(s[e][keep[e]].sum() / count)
    assert scores[2]["teacher_reward"] == 0.0 and scores[2]["num_completion_tokens"] == 1
    objective = distill.sampled_token_objective(rows).first()
    assert objective["loss"] == pytest.approx(-((t - s) * s)[keep].mean())
    assert distill_report(table, sampled_tokens_only=True, temperature=1.3).first()["loss"] == pytest.approx(
        objective["loss"]
    )


def test_top_k_rows_and_gather(table, cube):
    top = distill.top_k_tokens(table, 3)
    best = np.argsort(-cube[1], axis=-1, kind="stable")[..., :3]
    got = {(r["ex_id"], r["pos"], r["rank"]): r["token_id"] for r in top.collect()}
    assert got == {(e, p, k + 1): best[e, p, k] for e in range(EXAMPLES) for p in range(LENGTH) for k in range(3)}
    cells_long = table.select("ex_id", "pos", F.posexplode("student").alias("token_id", "logit"))
    gathered = distill.gather_at(cells_long, top, ["ex_id", "pos"])
    found = {(r["ex_id"], r["pos"], r["token_id"]): r["logit"] for r in gathered.collect()}
    for e, p, k in [(0, 0, 0), (1, 2, 2), (2, 3, 1)]:
        assert found[e, p, best[e, p, k]] == cube[0][e, p, best[e, p, k]]
    assert len(found) == EXAMPLES * LENGTH * 3


def test_ties_go_to_the_smaller_token(spark):
    df = spark.createDataFrame([(0, [5.0, 6.0, 7.0], [1.0, 2.0, 2.0])], "ex_id long, student array<double>, teacher array<double>")
    assert distill.top_k_tokens(df, 1).first()["token_id"] == 1


def test_divergence_by_token(table, spark):
    classes = spark.createDataFrame([(0, "style"), (1, "maths")], "sampled_id int, token_class string")
    rows = distill.position_divergence(table, beta=0)
    report = distill.divergence_by_token(rows, classes).collect()
    assert sum(r["num_tokens"] for r in report) == EXAMPLES * LENGTH
    assert {r["token_class"] for r in report if r["sampled_id"] > 1} <= {None}


def test_null_cells_and_unequal_vocabularies(spark):
    schema = "ex_id int, label int, student array<double>, teacher array<double>"
    null = spark.createDataFrame([(0, 1, [1.0, None], [1.0, 2.0])], schema)
    assert distill.position_divergence(null, clip=0.05).first()["divergence"] is None
    uneven = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0], [1.0, 2.0])], schema)
    for run in (
        lambda: distill.position_divergence(uneven).collect(),
        lambda: distill.position_divergence(uneven, top_k=2).collect(),
        lambda: distill.divergence_loss(uneven).collect(),
    ):
        with pytest.raises(Exception, match="Vocabularies differ"):
            run()


def test_all_reductions_in_one_pass(table):
    halves = table.withColumn("half", F.col("pos") % 2)
    rows = distill.position_divergence(halves, beta=0.4)
    one = {(r["half"], r["reduction"]): r for r in distill.reduce_divergence_all_ways(rows, ["half"]).collect()}
    two = {(r["half"], r["reduction"]): r for r in distill.divergence_losses(halves, ["half"], beta=0.4).collect()}
    assert one.keys() == two.keys() and len(one) == 8
    for key, row in one.items():
        half, how = key
        reduction, label = ("batchmean", None) if how == "per example" else (how, "label")
        wanted = distill.reduce_divergence(rows.where(F.col("half") == half), reduction=reduction, label=label).first()
        assert row["loss"] == pytest.approx(wanted["loss"]) == pytest.approx(two[key]["loss"])
        assert row["num_tokens"] == wanted["num_tokens"] == two[key]["num_tokens"]
    masked = distill.divergence_losses(table.where("label = -100")).collect()
    assert [r["reduction"] for r in masked] == ["per example"]
