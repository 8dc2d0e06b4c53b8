"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. A lexicon is learned from labelled rows: words and word beginnings that occur in many more toxic rows
   than clean ones, with their log odds as weights.
2. Every text becomes a few numbers: lexicon hits, densities and weights, hits close to a second person
   pronoun, shares of capitals and of punctuation marks, and words with signs or digits among their
   letters, which are also read with the disguise removed.
3. Boosted trees are fitted to one part of the labelled rows and their margins calibrated on the other.

All fits use every labelled row that is not held out; scoring is row by row over all whole texts, so copies and hot sources cost nothing extra.

Defined cases: null and empty texts have all features 0 and a score as any other row; equal texts have
equal scores; repeated rows stay; if the labels lack a kind, every score is its share of toxic
rows (0 without labels). Only id and text are read for a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.common import known_labels, labelled_rows, schema_with, slices, small_batches, texts, written

#: Terms of the lexicon, toxic rows that must hold a term, and its least log odds.
TERMS, LEAST_ROWS, LEAST_ODDS = 3000, 4, 2.5
#: Terms that a task counts before it passes the counts on.
COUNTED = 50_000
#: Lengths of word beginnings that may become terms.
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, BINS = 20, 3, 32
#: Characters on either side of a hit in which a second person counts as near.
NEAR = 50
SECOND = re.compile(r" (?:you|your|youre|yours|u|ur|tu|te|toi|vous|votre|du|dich|dir|dein|deine|ihr|euch|sie|tú|ti|usted|vos) ")
FEATURES = ["hits", "hit_density", "weight", "weight_density", "strongest", "kinds", "disguised_hits", "near_second",
            "near_share", "second_density", "capitals", "punctuation", "exclamations", "disguised", "words"]
_WORDS = re.compile(r"[\W_]+")
# Begins where a run of letters or signs begins and gives no letter back: a plain word is looked at once.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*.\-_+]++[^\W\d_]++)++|(?<![@$0-9])[@$0-9]++[^\W\d_]{2,}")
#: Any disguised word has such a pair.
_SIGNED = re.compile(r"[0-9@$!|*.\-_+][^\W\d_]")
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l",
                        **dict.fromkeys("*.-_+2689", "")})
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def plain(text: str) -> str:
    """Lower case, words separated and surrounded by one space."""
    if text.isascii():
        return f" {' '.join(text.translate(_ASCII).split())} "
    return f" {_WORDS.sub(' ', text.lower()).strip()} "


def disguised(text: str) -> list[str]:
    """Words with signs or digits among their letters, read without them."""
    lower = text.lower()
    return [w.translate(_PLAIN) for w in _DISGUISED.findall(lower)] if _SIGNED.search(lower) else []


def candidates(text: str) -> set[str]:
    """The words of a text, each followed by a space, and their beginnings."""
    words = set(plain(text).split())
    words.update(disguised(text))
    found = {f" {w} " for w in words}
    for n in BEGINNINGS:
        found.update(f" {w[:n]}" for w in words if len(w) >= n)
    return found


@dataclass
class Scorer:
    """Without trees every score is ``rate``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    rate: float


class Reader:
    """Features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.found = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.found.add_word(term, (len(term), weight))
        if lexicon:
            self.found.make_automaton()
        self.any = bool(lexicon)

    def _hits(self, text: str) -> dict[int, float]:
        """The largest weight at each word that has one."""
        out: dict[int, float] = {}
        if self.any:
            for end, (size, weight) in self.found.iter(text):
                at = end - size + 1
                if weight > out.get(at, 0.0):
                    out[at] = weight
        return out

    def features(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words = plain(text)
        n = max(1, words.count(" ") - 1)
        hits = self._hits(words)
        hidden = disguised(text)
        hidden_hits = self._hits(" " + "  ".join(hidden) + " ") if hidden else {}
        second = [m.start() for m in SECOND.finditer(words)]
        near = 0
        if hits and second:
            at = np.array(second)
            where = np.searchsorted(at, np.array(list(hits)))
            for p, i in zip(hits, where):
                near += any(abs(int(at[j]) - p) <= NEAR for j in (i - 1, i) if 0 <= j < len(at))
        raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size = float(raw.sum())
        every = list(hits.values()) + list(hidden_hits.values())
        total = sum(every)
        return [float(len(every)), len(every) / n, total, total / n, max(every, default=0.0),
                float(len({words[p:words.index(' ', p + 1)] for p in hits})), float(len(hidden_hits)), float(near),
                near / max(1, len(hits)), len(second) / n, raw[65:91].sum() / size, raw[_SIGNS].sum() / size,
                raw[33] / size, len(hidden) / n, math.log1p(n)]


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> dict[str, float]:
    """Terms of the sample (text, label) with their log odds; counts combine before the shuffle."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array(counts, pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                pa.array([c[0] for c in counts.values()], pa.int64())], ["term", "a", "b"])
            counts.clear()
            return out

        for batch in batches:
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                for t in candidates(text):
                    counts.setdefault(t, [0, 0])[int(y)] += 1
                if len(counts) > COUNTED:
                    yield passed()
        yield passed()

    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).head()
    counts = sample.select("text", "label").mapInArrow(run, "term string, a bigint, b bigint").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_ROWS)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (rows - toxic + 1.0))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(odds / spread), "term").limit(terms)
    return {r.term: float(r.odds) for r in best.collect()}


def with_features(df: DataFrame, lexicon: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``features``, an array in the order of FEATURES."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for part in slices(batches, "_text"):
            found = pa.array([reader.features(t) for t in texts(part.column(0))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], found], [*keep, "features"])

    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{k}`") for k in keep])
    return rows.mapInArrow(run, schema_with(df, keep, features="array<double>"))


def _margins(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return trees.transform(df.withColumn("_vector", array_to_vector("features"))).withColumn(
        "margin", vector_to_array("_raw")[1]).drop("_vector", "_raw", "features")


def fit(docs: DataFrame, labels: DataFrame, left_out: Column, label: str = "toxic", key: str = "doc_id") -> Scorer:
    """``left_out`` is a condition on the labels' key: those rows are never learned from."""
    known = written(labelled_rows(docs, labels, label, left_out, key), "labelled")
    lexicon = learn_lexicon(known)
    return _fitted(with_features(known, lexicon, [key, "label"]), lexicon, key)


def _fitted(known: DataFrame, lexicon: dict[str, float], key: str) -> Scorer:
    """Trees and curve of labelled rows (key, label, features)."""
    rows = written(known.select(key, "label", "features", F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(3)).alias("fold")), "features")
    rate, kinds = rows.agg(F.avg("label"), F.count_distinct(F.when(F.col("fold") > 0, F.col("label")))).head()
    if kinds < 2:
        return Scorer(lexicon, None, None, rate or 0.0)
    booster = GBTClassifier(labelCol="label", featuresCol="_vector", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS,
                            stepSize=0.2, seed=7, cacheNodeIds=True)
    booster.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
    trees = booster.fit(rows.where("fold <> 0").withColumn("_vector", array_to_vector("features")))
    ends = rows.sparkSession.range(2).select((F.col("id") * 200.0 - 100).alias("margin"), F.col("id").cast("double").alias("label"))
    curve = IsotonicRegression(labelCol="label", featuresCol="margin", predictionCol="score").fit(
        _margins(trees, rows.where("fold = 0")).select("margin", "label").unionByName(ends))
    return Scorer(lexicon, trees, curve, rate)


def scored(docs: DataFrame, labels: DataFrame, left_out: Column, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of all documents by a scorer fitted to their labelled rows.

    The same as :func:`fit` and :func:`score`, but features are read once and stored, and labels meet them there.
    """
    known = written(labelled_rows(docs, labels, label, left_out, key), "labelled")
    lexicon = learn_lexicon(known)
    read = written(with_features(docs, lexicon, [key]), "read")
    scorer = _fitted(read.join(known_labels(labels, label, left_out, key), key), lexicon, key)
    return _judged(read, scorer, [key])


def score(df: DataFrame, scorer: Scorer, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, ``score`` between 0 and 1, and ``predicted`` (1 from one half up)."""
    rows = df if scorer.trees is None else with_features(df, scorer.lexicon, keep, text)
    return _judged(rows, scorer, keep)


def _judged(rows: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """Scores of rows with their features."""
    if scorer.trees is None:
        return rows.select(*keep, F.lit(scorer.rate).alias("score"), F.lit(int(scorer.rate >= 0.5)).alias("predicted"))
    found = scorer.curve.transform(_margins(scorer.trees, rows)).withColumn(
        "score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
    return found.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
