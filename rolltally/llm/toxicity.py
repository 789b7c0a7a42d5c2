"""Toxic passages as maximum-scoring segments of token log-odds.

Training, on a bounded sample of the labelled rows: log-odds of each feature (a word or its
first three to eight letters) between toxic and other texts, with a Dirichlet prior in
proportion to the corpus, kept where their z-score says so. A token scores as its most
significant feature, every other token a small penalty. One linear scan finds all maximal
scoring segments (Ruzzo and Tompa). Karlin-Altschul statistics, fitted on texts without
toxic label, turn a segment's score into how unlikely it is in a text of that length. What
the best segment, all significant ones and all of them against the text's length say becomes
a probability by logistic regression. Rows are dealt to folds, and each fold is measured by
log-odds of the others, so every row serves both the log-odds and the regression. What comes
to the driver are features that several texts share and a few numbers per labelled text.

Defined results: null and empty texts have no segments and get the score of a text without
evidence. Labels that are null, contradictory (a toxic one wins) or repeated count once per
id. Without usable labels of both kinds every score is the share of toxic labels, or 0. Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm.common import give_back, handover, named, packed

# The model is fitted on at most so many labelled rows, which bounds its features too.
SAMPLE_ROWS = 60_000
# Parts of these rows; each part is measured by a model learnt from the others.
FOLDS = 3
MIN_DOCS = 4
MIN_Z = 3.0
PRIOR_TOKENS = 1000.0
PENALTY = 0.3
SIGNIFICANT = 0.05
CACHE_WORDS = 150_000
FLUSH_FEATURES = 120_000
# Words counted at once, or those of one longer text.
COUNT_WORDS = 1 << 17

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters, lower-case."""
    return _TOKEN.findall(text.lower()) if text else []


def features(token: str) -> list[str]:
    """The word itself (marked as whole) and its first three to eight letters."""
    return [token + "$", *(token[:n] for n in range(8, 2, -1) if len(token) >= n)]


@dataclass
class Model:
    """All that scoring takes; features are those of ``SAMPLE_ROWS`` texts that are significant."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    fixed: float | None = None
    name: str = field(default_factory=lambda: uuid4().hex)

    def token_score(self, token: str) -> float:
        best = max((self.weights[f] for f in features(token) if f in self.weights), key=lambda w: abs(w[1]), default=None)
        return -PENALTY if best is None else best[0] - PENALTY

    def evidence(self, segment_score: float, n_tokens: int) -> float:
        """Minus the logarithm of the expected number of such segments in such a text."""
        return self.decay * segment_score - math.log(self.scale * max(1, n_tokens))

    def probability(self, summary: tuple[float, ...]) -> float:
        if self.fixed is not None:
            return self.fixed
        x = self.coefficients[0] + sum(c * v for c, v in zip(self.coefficients[1:], summary))
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in order.

    Positive scores are visited once; each candidate is merged at most once.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int]] = []
    links: list[int] = []  # of each candidate: the nearest to its left that begins lower
    for at, low, high in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist()):
        start, end = at, at + 1
        while found:
            # Of the candidates to the left, those that begin no lower cannot be joined.
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = links[j]
            if j < 0 or found[j][1] >= high:
                break
            low, start = found[j][0], found[j][2]
            del found[j:], links[j:]
        j = len(found) - 1
        while j >= 0 and found[j][0] >= low:
            j = links[j]
        found.append((low, high, start, end))
        links.append(j)
    return [(start, end, high - low) for low, high, start, end in found]


class _Scores(dict):
    """Scores of words, computed when they are first looked up."""

    def __init__(self, score) -> None:
        self.score = score

    def __missing__(self, word: str) -> float:
        self[word] = found = self.score(word)
        return found


class Scorer:
    """Scores texts; words seen before are looked up."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, _Scores(model.token_score)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.float64, count=len(words))

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        return len(words), segments(self.scores(words))

    def summary(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        """Evidence of the best segment, of all significant ones together, and of all against the length."""
        evidence = [self.model.evidence(s, n) for _, _, s in found]
        limit = -math.log(SIGNIFICANT)
        graded = math.log1p(self.model.decay * sum(s for _, _, s in found)) - 0.5 * math.log1p(n)
        return max([0.0, *evidence]), math.log1p(sum(e for e in evidence if e >= limit)), graded

    def text(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        n, found = self.passages(text)
        limit = -math.log(SIGNIFICANT)
        return self.model.probability(self.summary(n, found)), [x for x in found if self.model.evidence(x[2], n) >= limit]


def _rows(batch: pa.RecordBatch, size: int = 256):
    """Rows of the first two columns as Python values, a few at a time."""
    for first in range(0, len(batch), size):
        part = batch.slice(first, size)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled ids, chosen by a hash of the id.

    What is broadcast are the chosen ids and labels: ``rows`` pairs of numbers at most.
    """
    one_each = labels.select(named(labels, "doc_id").cast("long").alias("id"), named(labels, "toxic").cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = one_each.orderBy(F.xxhash64("id"), "id").limit(rows)
    source = docs.select(named(docs, "doc_id").cast("long").alias("id"), named(docs, "text").cast("string").alias("text"))
    return source.join(F.broadcast(chosen), "id").select("id", "text", "toxic")


class _Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[starts], np.diff(starts, append=len(values))


class FeatureCounter:
    """How often features occur in texts of each fold and label, counted by distinct words of some texts at a time."""

    def __init__(self) -> None:
        self.words, self.features = _Numbered(), _Numbered()
        # Of every word met: where its features begin among those of all words.
        self.of_words, self.starts = [], [0]
        self.n = np.zeros((FOLDS, 3, 0), dtype=np.int64)
        self._begin()

    def _begin(self) -> None:
        self.ids, self.sizes, self.toxic, self.folds, self.pending = [], [], [], [], 0

    def add(self, words: list[str], toxic: int, fold: int) -> None:
        self.ids.extend(map(self.words.__getitem__, words))
        self.sizes.append(len(words))
        self.toxic.append(toxic)
        self.folds.append(fold)
        self.pending += len(words)

    def count(self) -> None:
        """Count the texts added since the last call."""
        for word in islice(self.words, len(self.starts) - 1, None):
            self.of_words.extend(map(self.features.__getitem__, features(word)))
            self.starts.append(len(self.of_words))
        starts, n_words, n_features = np.array(self.starts), max(1, len(self.words)), max(1, len(self.features))
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        each, times = _counted(text * n_words + np.array(self.ids, dtype=np.int64))
        text, word = each // n_words, each % n_words
        sizes = starts[word + 1] - starts[word]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(starts[word] - (ends - sizes), sizes)
        feature, text, times = np.array(self.of_words, dtype=np.int64)[at], np.repeat(text, sizes), np.repeat(times, sizes)
        toxic, fold = np.array(self.toxic, dtype=np.int64), np.array(self.folds, dtype=np.int64)
        cells = FOLDS * 3 * n_features
        counts = np.bincount(((fold * 3 + toxic)[text]) * n_features + feature, times, cells)
        once, _ = _counted(text * n_features + feature)
        counts += np.bincount((fold * 3 + 2)[once // n_features] * n_features + once % n_features, minlength=cells)
        counts = counts.astype(np.int64).reshape(FOLDS, 3, n_features)
        counts[:, :, : self.n.shape[2]] += self.n
        self.n = counts
        self._begin()

    def rows(self) -> pa.RecordBatch:
        fold, feature = np.nonzero(self.n[:, 2])
        names = pa.array(list(self.features), pa.string()).take(pa.array(feature))
        columns = [pa.array(fold.astype(np.int32)), *(pa.array(self.n[fold, k, feature]) for k in range(3))]
        return pa.RecordBatch.from_arrays([names, *columns], names=["feature", "fold", "n0", "n1", "docs"])


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature``, ``fold`` and how often it occurs in clean (``n0``) and toxic texts (``n1``), and in how many."""

    def count(batches):
        counter = FeatureCounter()
        for batch in batches:
            for (text, toxic), fold in zip(_rows(batch), batch.column(2).to_pylist()):
                counter.add(tokens(text), toxic, fold)
                if counter.pending > COUNT_WORDS:
                    counter.count()
                    if len(counter.features) > FLUSH_FEATURES:
                        yield counter.rows()
                        counter = FeatureCounter()
        counter.count()
        yield counter.rows()
        del counter
        give_back()

    toxic = F.least(F.greatest("toxic", F.lit(0)), F.lit(1))
    rows = sample.select("text", toxic.alias("toxic"), "fold").mapInArrow(count, "feature string, fold int, n0 long, n1 long, docs long")
    counted = rows.groupBy("feature", "fold").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "docs")))
    # Written, so that the texts are counted once for the sums and the features of all folds.
    return handover(sample.sparkSession, counted, "feature-counts")


def feature_log_odds(counted: DataFrame) -> DataFrame:
    """``feature``, ``log_odds`` (with Dirichlet prior) and ``z`` of the significant features."""
    kind = F.when(F.col("feature").endswith("$"), F.lit(0)).otherwise(F.length("feature"))
    counted = counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "docs"))).withColumn("kind", kind)
    totals = counted.groupBy("kind").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    joined = counted.where(F.col("docs") >= MIN_DOCS).join(F.broadcast(totals), "kind")  # one row per kind
    prior = F.lit(PRIOR_TOKENS) * (F.col("n0") + F.col("n1")) / (F.col("t0") + F.col("t1"))
    a, b = F.col("n1") + prior, F.col("n0") + prior
    odds = F.log(a / (F.col("t1") + PRIOR_TOKENS - a)) - F.log(b / (F.col("t0") + PRIOR_TOKENS - b))
    scored = joined.select("feature", odds.alias("log_odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    return scored.where(F.abs("z") >= MIN_Z)


def _gumbel(maxima: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Decay and scale of the extreme-value law of the best segment in n tokens, by moments."""
    if len(maxima) < 2 or maxima.std() < 1e-6:  # nothing varies, so there is no law to fit
        return 1.0, 1.0
    # The maximum of n tokens is about (ln(K n) + g) / decay with g of Gumbel's law.
    decay = math.pi / math.sqrt(6) / float(maxima.std())
    scale = math.exp(float(np.mean(decay * maxima - np.log(lengths))) - 0.5772156649)
    return decay, max(scale, 1e-9)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a light ridge, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model on the labelled rows given; at most ``rows`` of them are used."""
    fold = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(FOLDS)).cast("int")
    sample = handover(spark, labelled_sample(docs, labels, rows).withColumn("fold", fold), "labelled")
    counts = {r["toxic"] != 0: r["n"] for r in sample.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(fixed=1.0 if counts.get(True) else 0.0)
    counted = feature_counts(sample)

    def learned(rows_of: DataFrame) -> Model:
        return Model(weights={r["feature"]: (r["log_odds"], r["z"]) for r in feature_log_odds(rows_of).collect()})  # of ``rows`` texts at most

    x, y, laws = [], [], []
    for part in range(FOLDS):
        model = learned(counted.where(F.col("fold") != part))
        held = sample.where(F.col("fold") == part).select("text", (F.col("toxic") != 0).cast("int").alias("toxic"))
        # Kept, so that the texts are scanned once for the law and the regression.
        found = _measure(held, model).persist()
        measured = found.select("n", "best", "toxic").collect()  # three numbers a text
        clean = [(r["n"], r["best"]) for r in measured if not r["toxic"] and r["best"] > 0]
        model.decay, model.scale = _gumbel(np.array([m for _, m in clean]), np.array([max(1, n) for n, _ in clean], dtype=float))
        again = _summaries(found, model).collect()
        found.unpersist()
        x += [(r["a"], r["b"], r["c"]) for r in again]
        y += [float(r["toxic"]) for r in again]
        if clean:
            laws.append((model.decay, math.log(model.scale), len(clean)))
    model = learned(counted)
    if laws:
        weight = sum(n for _, _, n in laws)
        model.decay = sum(d * n for d, _, n in laws) / weight
        model.scale = math.exp(sum(s * n for _, s, n in laws) / weight)
    model.coefficients = _logistic(np.array(x), np.array(y))
    return model


def _measure(sample: DataFrame, model: Model) -> DataFrame:
    """Tokens, best segment score, all of them and label of every text."""

    def measure(batches):
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for text, toxic in _rows(batch):
                n, found = scorer.passages(text)
                scores = [s for _, _, s in found]
                out.append((n, max(scores, default=0.0), scores, toxic))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _MEASURED)], names=["n", "best", "scores", "toxic"])
        scorer = out = columns = None
        give_back()

    return sample.mapInArrow(measure, "n long, best double, scores array<double>, toxic int")


_MEASURED = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int32())


def _summaries(measured: DataFrame, model: Model) -> DataFrame:
    """What the logistic fit takes of every text, and its label."""

    def summarise(batches):
        scorer = Scorer(model)
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
            out = [(*scorer.summary(n, [(0, 0, s) for s in scores]), toxic) for n, scores, toxic in rows]
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "c", "toxic"])

    return measured.select("n", "scores", "toxic").mapInArrow(summarise, "a double, b double, c double, toxic int")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``passages`` (token spans with their scores) of every row."""

    def scan(batches):
        scorer = _scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            out = [scorer.text(t) for _, t in _rows(batch)]
            spans = [[{"start": a, "end": b, "score": s} for a, b, s in found] for _, found in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    source = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns, in one narrow pass.

    Rows without an id or text are kept like any other text without evidence.
    """
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        scorer = _scorer(model)
        scores = pd.Series([scorer.text(t)[0] for t in texts], dtype="float64")
        give_back()
        return scores

    return packed(docs, score=score(named(docs, "text").cast("string"))).where(F.col("score") < limit).select("row.*")


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer per model and worker, so that its cache of words lasts."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]
