"""A quality score from histogram gradient-boosted trees over document statistics.

Features are cut into at most 64 bins by the quantiles of a bounded sample; trees are grown level
by level from histograms of gradients. All trees are flattened into arrays, a slot for each node
of a full tree, and scored for a whole batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from querytide.llm.common import prepare, text_bytes
from querytide.llm.text_stats import COUNTS, RATIOS, counts, labelled_features


@dataclass(frozen=True)
class TreeParams:
    #: Labelled documents learned from, at most.
    sample: int = 20_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    leaf_weight: float = 2.0
    penalty: float = 1.0
    #: A score from here on predicts label 1.
    threshold: float = 0.3


@dataclass(frozen=True)
class Trees:
    """`feature` and `cut` by tree and inner node, `value` by tree and leaf, and the prior."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), "i8")
            while len(x) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, label: np.ndarray, params: TreeParams = TreeParams()) -> Trees:
    """Trees for labels 0 and 1; without rows of both labels they know the prior alone."""
    inner, leaves = 2**params.depth - 1, 2**params.depth
    share = (label.sum() + 1) / (len(label) + 2)
    prior = float(np.log(share / (1 - share)))
    count = params.trees if 0 < label.sum() < len(label) else 0
    feature = np.zeros((count, inner), "i8")
    cut = np.full((count, inner), np.inf)
    value = np.zeros((count, leaves))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, params.bins + 1)[1:-1])) for c in x.T] if count else []
    binned = [np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)]
    total = np.full(len(label), prior)
    for tree in range(count):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = label - p, p * (1 - p)
        node = np.zeros(len(label), "i8")
        for level in range(params.depth):
            first = 2**level - 1
            here, width = node - first, 2**level
            best = np.full(width, 1e-9)
            for k, bins in enumerate(binned):
                n = len(cuts[k]) + 1
                at = here * n + bins
                g = np.bincount(at, gradient, width * n).reshape(width, n).cumsum(axis=1)
                h = np.bincount(at, weight, width * n).reshape(width, n).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = (
                    gl**2 / (hl + params.penalty)
                    + (gt - gl) ** 2 / (ht - hl + params.penalty)
                    - gt**2 / (ht + params.penalty)
                )
                gain[(hl < params.leaf_weight) | (ht - hl < params.leaf_weight)] = 0
                if n > 1:
                    at_best = gain.argmax(axis=1)
                    found = gain[np.arange(width), at_best]
                    for i in np.flatnonzero(found > best):
                        best[i] = found[i]
                        feature[tree, first + i], cut[tree, first + i] = k, cuts[k][at_best[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[tree, node]] > cut[tree, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value[tree] = params.rate * g / (h + params.penalty)
        total += value[tree][leaf]
    return Trees(feature, cut, value, prior)


def features(table: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS; a share of nothing is zero."""
    column = dict(zip(COUNTS, table.T.astype("f8")))
    shares = [column[top] / np.maximum(column[bottom], 1) * (column[bottom] > 0) for _, top, bottom in RATIOS]
    return np.stack(shares, axis=1)


def learn(docs: DataFrame, labels: DataFrame, params: TreeParams = TreeParams()) -> Trees:
    """Trees from a bounded sample of the labelled documents (`quality`)."""
    x, label = labelled_features(docs, labels, "quality", params.sample)
    return train(x, label, params)


def score(docs: DataFrame, trees: Trees, params: TreeParams = TreeParams()) -> DataFrame:
    """`doc_id`, `score` and `predicted` for every row.

    A null text scores as an empty one, whose statistics are all zero. Repeated rows and null
    doc_ids stay as they are; other columns are not read. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        table = np.array([counts(t) for t in text_bytes(values)], "i8").reshape(-1, len(COUNTS))
        return pa.array(model.value.score(features(table)), pa.float64())

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


