"""Random forests of deep trees whose nodes never meet on the driver.

MLlib grows the upper levels of all trees. Below them, the rows of one leaf of one tree, some bytes
each, go to a task together, which grows that leaf's subtree to the full depth. Subtrees are a table in the shared folder, one row for each leaf
of an upper tree, and rows are scored by meeting it on (tree, leaf). The driver holds the upper levels only.

A subtree has a bootstrap sample of its own (Poisson weights), drawn from its tree and leaf. Features are compared at fixed
cuts (:func:`feature_cuts`). A feature vector has one score, so copies are scored once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from mailsift import fixed
from mailsift.operators.skew import join_facts
from mailsift.session import scratch_path, written

TREES, DEPTH = 100, 30

#: Up to so many training rows MLlib grows all levels.
WHOLE_ROWS = 20_000
#: Rows aimed at in a leaf of the upper levels.
LEAF_ROWS = 8_192
#: Rows of all trees, some bytes each, that a task which grows leaves reads.
TASK_ROWS = 2_000_000

#: Parts into which cuts divide a feature, as many as in MLlib.
BINS = 32
CUT_ROWS = 10_000

PACKED = "tree int, leaf int, ids binary, bins binary, label binary"
SUBTREES = ("tree int, leaf int, n double, ones double, importance array<double>, feature binary, cut binary, child binary, chance binary")
#: Scores are added as whole numbers, so their order does not matter.
UNIT = float(1 << 40)


def upper_depth(rows: int) -> int:
    """Levels that MLlib grows; two more than even halves would need."""
    return DEPTH if rows <= WHOLE_ROWS else min(DEPTH, math.ceil(math.log2(rows / LEAF_ROWS)) + 2)


def whole_trees(features: str) -> RandomForestClassifier:
    """Deep trees: node ids are kept with the rows instead of walking all trees for every level."""
    return RandomForestClassifier(featuresCol=features, maxDepth=DEPTH, **_settings())


def upper_trees(depth: int, features: str) -> RandomForestRegressor:
    """The variance of a label 0 or 1 is half its Gini impurity, so splits are the same; a classifier would also
    close sibling leaves that say the same, which are to be grown further here."""
    return RandomForestRegressor(featuresCol=features, maxDepth=depth, **_settings())


def _settings() -> dict:
    return {"numTrees": TREES, "featureSubsetStrategy": "sqrt", "seed": fixed.SEED, "maxMemoryInMB": 1024, "cacheNodeIds": True}


def feature_cuts(df: DataFrame, features: str, rows: int) -> list[list[float]]:
    """Ascending cuts of each feature, found as MLlib finds those of the upper levels: from about CUT_ROWS rows, which
    place the cuts only. Trees are grown on all rows."""
    drawn = df.sample(False, min(1.0, CUT_ROWS / max(rows, 1)), fixed.SEED).select(vector_to_array(F.col(features)).alias("x"))
    x = np.array([r["x"] for r in drawn.collect()])
    return [stride_cuts(x[:, i]) for i in range(x.shape[1])]


def stride_cuts(v: np.ndarray) -> list[float]:
    """Between neighbouring values: at all of them if few, else where a stride of rows is full; what a common value
    takes of several strides is made up by the values after it."""
    kinds, counts = np.unique(v, return_counts=True)
    middles = ((kinds[:-1] + kinds[1:]) / 2).tolist()
    if len(middles) < BINS:
        return middles
    cuts, stride = [], len(v) / BINS
    target = stride
    for middle, before, after in zip(middles, np.cumsum(counts)[:-1], np.cumsum(counts)[1:]):
        if abs(before - target) < abs(after - target):
            cuts.append(middle)
            target += stride
    return cuts


def _packer(cuts: list[list[float]], labelled: bool):
    """Rows of an Arrow batch by tree and leaf: a place counts the cuts below a value, and has one byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            leaves = batch["leaves"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            ids = batch["vid"].to_numpy(zero_copy_only=False).astype(np.int64)
            labels = batch["label"].to_numpy(zero_copy_only=False).astype(np.uint8) if labelled else np.zeros(n, np.uint8)
            out = [[], [], [], [], []]
            for tree in range(leaves.shape[1]):
                order = np.argsort(leaves[:, tree], kind="stable")
                found, first = np.unique(leaves[order, tree], return_index=True)
                for leaf, rows in zip(found.tolist(), np.split(order, first[1:])):
                    for column, value in zip(out, (tree, leaf, b"" if labelled else ids[rows].tobytes(),
                                                   bins[rows].tobytes(), labels[rows].tobytes() if labelled else b"")):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])],
                names=["tree", "leaf", "ids", "bins", "label"])
    return run


def grow(bins: np.ndarray, ones: np.ndarray, weights: np.ndarray, levels: int, rng: np.random.Generator):
    """(feature, cut, child, chance, importance) of a tree by Gini gain; ``child`` is the left one, the right one follows, 0: none.

    All nodes of a level are split together, those whose parts would say the same are closed again. Each looks at a random root of the features, as in the upper levels.
    """
    d = bins.shape[1]
    tries = math.ceil(math.sqrt(d))
    width = int(bins.max(initial=0)) + 1
    rows, node = np.flatnonzero(weights), np.zeros(len(bins), np.int64)
    feature, cut, child, gains, chance = [np.zeros(1, np.uint8)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)], [np.zeros(1)], []
    base, count = 0, 1
    for level in range(levels + 1):
        place = node[rows] - base
        w, y = weights[rows], weights[rows] * ones[rows]
        total, hits = np.bincount(place, w, count), np.bincount(place, y, count)
        chance.append(hits / np.maximum(total, 1e-300))
        open_ = np.flatnonzero((hits > 0) & (hits < total))
        if level == levels or not len(open_):
            break
        slot = np.full(count, -1)
        slot[open_] = np.arange(len(open_))
        inside = slot[place] >= 0
        rows, place = rows[inside], slot[place[inside]]
        w, y = w[inside], y[inside]
        m, n, h = len(open_), total[open_], hits[open_]
        picks = np.argsort(rng.random((m, d)), axis=1)[:, :tries]
        best, best_feature, best_cut = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        before = h * (n - h) / n
        for t in range(tries):
            at = place * width + bins[rows, picks[place, t]]
            left = np.cumsum(np.bincount(at, w, m * width).reshape(m, width), axis=1)
            left_hits = np.cumsum(np.bincount(at, y, m * width).reshape(m, width), axis=1)
            right, right_hits = n[:, None] - left, h[:, None] - left_hits
            with np.errstate(divide="ignore", invalid="ignore"):
                after = left_hits * (left - left_hits) / left + right_hits * (right - right_hits) / right
            gain = np.where((left > 0) & (right > 0), before[:, None] - after, -1.0)
            top = gain.argmax(axis=1)
            value = gain[np.arange(m), top]
            better = value > best
            best = np.where(better, value, best)
            best_feature = np.where(better, picks[:, t], best_feature)
            best_cut = np.where(better, top, best_cut)
        split = best > 1e-9 * n
        if not split.any():
            break
        number = np.cumsum(split) - 1
        parents = open_[split]
        feature[-1][parents], cut[-1][parents], gains[-1][parents] = best_feature[split], best_cut[split], 2 * best[split]
        child[-1][parents] = base + count + 2 * number[split]
        going = split[place]
        rows, place = rows[going], place[going]
        node[rows] = base + count + 2 * number[place] + (bins[rows, best_feature[place]] > best_cut[place])
        base, count = base + count, 2 * int(split.sum())
        for column, kind in ((feature, np.uint8), (cut, np.uint8), (child, np.int32), (gains, float)):
            column.append(np.zeros(count, kind))
    says = np.concatenate(chance) > 0.5
    # From the lowest level up, two leaves that say the same become one, as in MLlib.
    after, closed = np.zeros(0, bool), np.zeros(0, bool)
    start = len(says)
    for level in range(len(child) - 1, -1, -1):
        start -= len(child[level])
        below = start + len(child[level])
        parents = np.flatnonzero(child[level])
        if len(parents):
            left = child[level][parents] - below
            same = closed[left] & closed[left + 1] & (after[left] == after[left + 1])
            child[level][parents[same]] = 0
        closed, after = child[level] == 0, says[start:below]
    out, used = np.concatenate(child), np.concatenate(feature)
    importance = np.bincount(used, np.where(out > 0, np.concatenate(gains), 0.0), d)
    return used, np.concatenate(cut), out, np.concatenate(chance), importance


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(bins), np.int64)
    rows = np.flatnonzero(child[node])
    while len(rows):
        at = node[rows]
        node[rows] = child[at] + (bins[rows, feature[at]] > cut[at])
        rows = rows[child[node[rows]] > 0]
    return node


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(rows, axis=0, return_counts=True)`` of byte rows, compared eight bytes at once."""
    n, d = rows.shape
    padded = np.zeros((n, -(-d // 8) * 8), np.uint8)
    padded[:, :d] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
    return rows[order[first]], np.diff(np.append(first, n))


def _grower(d: int, levels: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        tree, leaf = table["tree"][0].as_py(), table["leaf"][0].as_py()
        bins, label = _joined(table, "bins", np.uint8).reshape(-1, d), _joined(table, "label", np.uint8)
        # Copies are one row of a weight; a sorted order makes the draws those of the rows, not of their arrival.
        both, copies = distinct_rows(np.column_stack([bins, label]))
        bins, ones = both[:, :-1], both[:, -1].astype(float)
        rng = np.random.default_rng([seed, tree, leaf])
        weights = rng.poisson(copies).astype(float)
        if not weights.any():
            weights = copies.astype(float)
        feature, cut, child, chance, importance = grow(bins, ones, weights, levels, rng)
        row = {"tree": [tree], "leaf": [leaf], "n": [float(weights.sum())], "ones": [float(weights @ ones)],
               "importance": [importance.tolist()], "feature": [feature.tobytes()], "cut": [cut.tobytes()],
               "child": [child.tobytes()], "chance": [np.rint(chance * UNIT).astype(np.int64).tobytes()]}
        return pa.table(row, schema=pa.schema([
            ("tree", pa.int32()), ("leaf", pa.int32()), ("n", pa.float64()), ("ones", pa.float64()),
            ("importance", pa.list_(pa.float64())), *((c, pa.binary()) for c in ("feature", "cut", "child", "chance"))]))
    return run


def _scorer(d: int):
    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if rows.num_rows:
            ids, bins = _joined(rows, "ids", np.int64), _joined(rows, "bins", np.uint8).reshape(-1, d)
            feature, cut, child, chance = (
                _joined(trees, c, kind) for c, kind in (("feature", np.uint8), ("cut", np.uint8), ("child", np.int32), ("chance", np.int64)))
            score = chance[walk(bins, feature, cut, child)]
        return pa.table({"vid": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})
    return run


def _leaves(head: RandomForestRegressionModel, df: DataFrame, features: str) -> DataFrame:
    return head.setLeafCol("_leaves").transform(df).withColumns({
        "x": vector_to_array(F.col(features)), "leaves": vector_to_array(F.col("_leaves"))})


class DeepForestModel(Transformer, MLReadable, MLWritable):
    """Upper trees, cuts and the path of the subtrees. Scores tables; a stream scores its batches by ``foreachBatch``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "ascending cuts of each feature", TypeConverters.toList)

    def __init__(self, head: RandomForestRegressionModel, path: str, features: str, cuts: list[list[float]],
                 importances: list[float]):
        super().__init__()
        self.head, self.path, self.importances = head, path, importances
        self._set(featuresCol=features, cuts=cuts)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def subtrees(self, spark) -> DataFrame:
        return spark.read.schema(SUBTREES).parquet(self.path)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, cuts = self.getOrDefault(self.featuresCol), self.getOrDefault(self.cuts)
        spark, trees = dataset.sparkSession, len(self.head.trees)
        keyed = dataset.withColumn("_x", vector_to_array(F.col(features)))
        kinds = written(keyed.select(F.col("_x").alias("x")).distinct().withColumn("vid", F.monotonically_increasing_id()), "forest-rows")
        ready = _leaves(self.head, kinds.withColumn(features, array_to_vector("x")), features).select("vid", "x", "leaves")
        packed = ready.mapInArrow(_packer(cuts, False), PACKED)
        scored = packed.groupBy("tree", "leaf").cogroup(self.subtrees(spark).groupBy("tree", "leaf")).applyInArrow(
            _scorer(len(cuts)), "vid bigint, score bigint")
        # Every leaf of an upper tree holds training rows, so every row meets one subtree a tree.
        chance = scored.groupBy("vid").agg((F.sum("score") / F.lit(trees * UNIT)).alias("_chance"))
        facts = kinds.join(chance, "vid").select(F.col("x").alias("_x"), "_chance")
        out = join_facts(keyed, facts, "_x").drop("_x")
        one = F.col("_chance")
        return out.withColumns({
            "rawPrediction": array_to_vector(F.array((1 - one) * trees, one * trees)),
            "probability": array_to_vector(F.array(1 - one, one)),
            "prediction": (one > 0.5).cast("double")}).drop("_chance")

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"importances": model.importances})
        model.head.write().save(f"{path}/head")
        model.subtrees(spark).write.parquet(f"{path}/subtrees")


class _ForestReader(MLReader):
    def load(self, path: str) -> DeepForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        params = metadata["paramMap"]
        model = DeepForestModel(RandomForestRegressionModel.load(f"{path}/head"), f"{path}/subtrees",
                                params["featuresCol"], params["cuts"], metadata["importances"])
        model._resetUid(metadata["uid"])
        return model


def importances(head: RandomForestRegressionModel, subtrees: DataFrame) -> list[float]:
    """Shares of the gain of each feature, every tree counting the same.

    MLlib gives shares of the upper gains of a tree; their sum is what the leaves lack of the impurity of all rows.
    """
    impurity = 2 * F.col("ones") * (F.col("n") - F.col("ones")) / F.col("n")
    d = head.numFeatures
    found = subtrees.groupBy("tree").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum(impurity).alias("left"),
        *[F.sum(F.col("importance")[i]).alias(f"i{i}") for i in range(d)]).collect()
    out = np.zeros(d)
    for r in found:
        above = max(0.0, 2 * r["ones"] * (r["n"] - r["ones"]) / r["n"] - r["left"])
        gains = head.trees[r["tree"]].featureImportances.toArray() * above + np.array([r[f"i{i}"] for i in range(d)])
        out += gains / gains.sum() if gains.sum() else gains
    return (out / out.sum() if out.sum() else out).tolist()


def fit_below(head: RandomForestRegressionModel, train: DataFrame, rows: int, depth: int, features: str) -> DeepForestModel:
    """Subtrees of all leaves of the upper trees, grown side by side and stored."""
    cuts = feature_cuts(train, features, rows)
    placed = _leaves(head, train, features).select(F.lit(0).cast("bigint").alias("vid"), "x", "leaves", "label")
    # Rows that lie in one partition would keep all leaves of all trees in its task.
    spark = train.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows * len(head.trees) // TASK_ROWS))
    packed = placed.mapInArrow(_packer(cuts, True), PACKED).repartition(tasks, "tree", "leaf")
    grown = packed.groupBy("tree", "leaf").applyInArrow(_grower(len(cuts), DEPTH - depth, fixed.SEED), SUBTREES)
    path = scratch_path(spark, "subtrees")
    grown.write.parquet(path)
    shares = importances(head, spark.read.schema(SUBTREES).parquet(path))
    return DeepForestModel(head, path, features, cuts, shares)


class DeepForest(Estimator):
    """``rows`` says how large the training table is, and so how many levels MLlib grows."""

    def __init__(self, features: str, rows: int):
        super().__init__()
        self.features, self.rows = features, rows

    def _fit(self, dataset: DataFrame) -> Model:
        depth = upper_depth(self.rows)
        if depth == DEPTH:
            return whole_trees(self.features).fit(dataset)
        return fit_below(upper_trees(depth, self.features).fit(dataset), dataset, self.rows, depth, self.features)
