"""Quality scores by Bradley-Terry pairwise ranking.

Every text has a strength, a weighted sum of its features. That a good text is preferred to a bad one has
the probability logistic(difference of strengths), so the weights are those of a logistic regression
without intercept on feature differences. Preference pairs come from all labelled rows: rows meet
by a hash of their ids, each preferred text with the few others of its cell. The strength at which a text
counts as good is a quantile of their strengths, the one that agrees best with the labels; scores
are the logistic function of the strength above it.

Features are shares and averages of a whole text: kinds of characters, lengths of words and lines, repeated
words and lines. Each enters as it is, squared, and as its logarithm, standardised on the labelled rows.

The fit uses every labelled row that is not held out; scoring is row by row over all whole texts. Labels meet the features
of a text, not the text, and one reading serves fit and scores (:func:`read`).

Defined cases: null and empty texts have all features 0 and are scored like any other; equal texts have
equal scores; repeated rows stay; if the labels lack a kind, every score is its share of good rows
(one half without labels). Only id and text are read for a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.common import known_labels, schema_with, slices, small_batches, texts, written

#: Rows of the rarer kind that meet in a cell on average.
CELL = 2
#: Quantiles of strength that are tried as the threshold.
QUANTILES = 400
SHARES = ["upper", "digits", "spaces", "lines_share", "other_ascii", "beyond_ascii", "stops", "exclamations", "signs", "pipes"]
FEATURES = [*SHARES, "word_length", "word_spread", "distinct_words", "commonest_word", "word_repeats", "signed_words",
            "line_length", "line_repeats", "short_lines", "words"]
_GROUPS = {"upper": range(65, 91), "digits": range(48, 58), "spaces": [32, 9], "lines_share": [10, 13],
           "other_ascii": [*range(0, 9), 11, 12, *range(14, 32), 127], "beyond_ascii": range(128, 256),
           "stops": [ord(c) for c in ".,;:?"], "exclamations": [33],
           "signs": [ord(c) for c in "#$%&*@^~=+<>\\_{}[]/"], "pipes": [124]}
_TABLE = np.array([[b in _GROUPS[g] for b in range(256)] for g in SHARES], float)


def features(text: str) -> np.ndarray:
    """Numbers between 0 and about 1 for every feature but the last, a logarithm."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    out[:len(SHARES)] = _TABLE @ raw / raw.sum()
    words = text.split()
    if words:
        sizes = np.fromiter(map(len, words), float, len(words))
        counts = Counter(words)
        same = sum(a == b for a, b in zip(words, words[1:]))
        signed = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:?")
        lines = [x for x in text.split("\n") if x.strip()]
        out[len(SHARES):] = [
            sizes.mean() / 20, sizes.std() / 20, len(counts) / len(words), max(counts.values()) / len(words),
            same / len(words), signed / len(counts), math.log1p(len(text) / len(lines)) / 10,
            1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), math.log1p(len(words)) / 10]
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Each feature as it is, squared, and as a logarithm that opens up the small shares."""
    return np.concatenate((x, x * x, np.log(x + 0.002)), axis=-1)


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expanded(x) - self.mean) / self.spread, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(x) - self.threshold, -40, 40)))


def read(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``x``, the features of the text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            x = pa.array([features(t) for t in texts(part.column(0))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], x], [*keep, "x"])

    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{k}`") for k in keep])
    return rows.mapInArrow(run, schema_with(df, keep, x="array<double>"))


def _pairs(rows: DataFrame, cells: int) -> DataFrame:
    """Feature differences of good and bad rows that meet in one of ``cells``."""
    placed = rows.withColumn("cell", F.pmod("cell", F.lit(cells)))
    better = placed.where("label = 1").select("cell", F.col("x").alias("a"))
    worse = placed.where("label = 0").select("cell", F.col("x").alias("b"))
    return better.join(worse, "cell").select(F.transform(F.arrays_zip("a", "b"), lambda z: z.a - z.b).alias("d"))


def fit(docs: DataFrame, labels: DataFrame, left_out: Column, label: str = "quality", key: str = "doc_id") -> Ranker:
    """``left_out`` is a condition on the labels' key: those rows are never learned from."""
    return fit_read(read(docs, [key]), labels, left_out, label, key)


def fit_read(rows: DataFrame, labels: DataFrame, left_out: Column, label: str = "quality", key: str = "doc_id") -> Ranker:
    """The same of documents that are read; labels meet a few numbers, and no text is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(expanded(x)), pa.list_(pa.float64()))], [key, "label", "x"])

    known = rows.select(key, "x").join(known_labels(labels, label, left_out, key), key).select(key, "label", "x")
    rows = written(known.mapInArrow(run, known.schema), "featured")
    n, good, *moments = rows.agg(
        F.count(F.lit(1)), F.sum("label"),
        *[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(3 * len(FEATURES))]).head()
    if not good or good == n:
        size = 3 * len(FEATURES)
        rate = min(0.9999, max(0.0001, good / n)) if n else 0.5
        return Ranker(np.zeros(size), np.ones(size), np.zeros(size), -math.log(rate / (1 - rate)))
    mean, spread = np.array(moments, float).reshape(2, -1)
    spread = np.maximum(spread, 1e-6)
    scaled = rows.select("label", F.xxhash64(key, F.lit("cell")).alias("cell"),
                         F.transform(F.arrays_zip("x", F.lit(mean.tolist()).alias("m"), F.lit(spread.tolist()).alias("s")),
                                     lambda z: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (z.x - z.m) / z.s))).alias("x"))
    pairs = _pairs(scaled, max(1, int(min(good, n - good) / CELL)))
    if pairs.isEmpty():  # only a handful of rows can miss each other in all cells
        pairs = _pairs(scaled, 1)
    both = pairs.select(F.lit(1.0).alias("label"), "d").unionByName(
        pairs.select(F.lit(0.0).alias("label"), F.transform("d", lambda v: -v).alias("d")))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(
        both.select("label", array_to_vector("d").alias("features")))
    ranker = Ranker(mean, spread, np.array(model.coefficients.toArray()), 0.0)
    strength = F.aggregate(F.zip_with("x", F.lit(ranker.weights.tolist()), lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v)
    known = scaled.select("label", strength.alias("strength"))
    cuts = known.agg(F.percentile_approx("strength", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).head()[0]
    tried = known.select("label", "strength", F.explode(F.lit(sorted(set(cuts)))).alias("cut")).groupBy("cut").agg(
        F.avg(F.when(F.col("label") == 1, (F.col("strength") >= F.col("cut")).cast("double"))).alias("kept"),
        F.avg(F.when(F.col("label") == 0, (F.col("strength") < F.col("cut")).cast("double"))).alias("dropped"))
    at = {r.cut: r.kept + r.dropped for r in tried.collect()}
    best = max(at.values())
    level = [c for c in sorted(at) if at[c] >= best - 1e-12]
    ranker.threshold = float(level[len(level) // 2])
    return ranker


def score(df: DataFrame, ranker: Ranker, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, ``score`` between 0 and 1, and ``predicted`` (1 from one half up)."""
    return score_read(read(df, keep, text), ranker, keep)


def score_read(rows: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """The same of documents that are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ranker.scores(x))], [*keep, "score"])

    found = rows.select("x", *[F.col(f"`{k}`") for k in keep]).mapInArrow(run, schema_with(rows, keep, score="double"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
