"""Gradient-boosted trees of many rows, fitted on their cells.

A tree over binned features can't tell rows apart that have the same bins and label:
they have one gradient. So all rows are counted by their bins and label in one pass,
and the trees are grown on the counts, as Spark's own trees would be on the rows:
logistic loss, the first tree on the labels, variance gain, means as leaves, a random
part of the features for each node, and a random part of the rows for each tree, drawn
as a binomial share of each cell. No row is left out of the counts. The result is a
Spark model.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature; a cell's bins are BITS bits each of one number.
BINS, BITS = 32, 5


class Tree(NamedTuple):
    """A complete tree in heap order (children of k: 2k + 1, 2k + 2); feature -1: a leaf."""

    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    count: np.ndarray
    weight: np.ndarray
    square: np.ndarray


def borders(rows: DataFrame, features: tuple[str, ...], label: str = "label") -> list[list[float]]:
    """Ascending borders of each feature: quantiles of both labels' rows, the largest value left out."""
    shares = F.array(*(F.lit(k / (BINS // 2)) for k in range(BINS // 2)))
    found = rows.groupBy(label).agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in features)).collect()
    most = rows.agg(*(F.max(f).alias(f) for f in features)).first()
    return [sorted({float(x) for row in found for x in row[f] or [] if x < most[f]})[: BINS - 1] for f in features]


def cells(rows: DataFrame, features: tuple[str, ...], cuts: list[list[float]], label: str = "label") -> DataFrame:
    """code, label, n: the rows of each combination of bins (a row's bin: the borders below it)."""
    code = F.lit(0).cast("bigint")
    for k, (f, own) in enumerate(zip(features, cuts)):
        for border in own:
            code = code + F.when(F.col(f) > border, F.lit(1 << (BITS * k))).otherwise(F.lit(0)).cast("bigint")
    return rows.select(code.alias("code"), F.col(label).cast("int").alias("label")).groupBy("code", "label").agg(F.count("*").alias("n"))


def _grow(bins: np.ndarray, n: np.ndarray, w: np.ndarray, target: np.ndarray, depth: int, tried: int, draw) -> tuple[Tree, np.ndarray]:
    """A tree and each cell's leaf; bins: a row of places for each feature, n and w: the
    sampled rows of each cell and their weight."""
    size = (1 << (depth + 1)) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, dtype=np.int64), *(np.zeros(size) for _ in range(5)))
    node = np.zeros(len(n), dtype=np.int64)  # within the heap
    s = w * target
    used = np.flatnonzero(n)
    for level in range(depth + 1):
        first, many = (1 << level) - 1, 1 << level
        here = used[node[used] >= first]
        at = node[here] - first
        here_w, here_s = w[here], s[here]
        W, S, Q, N = (np.bincount(at, x, many) for x in (here_w, here_s, here_s * target[here], n[here]))
        heap = slice(first, first + many)
        tree.weight[heap], tree.count[heap], tree.square[heap] = W, N, Q
        parent = (np.arange(first, first + many) - 1) // 2
        tree.value[heap] = np.where(W > 0, S / np.maximum(W, 1e-300), tree.value[parent] if level else 0.0)
        if level == depth or not len(here):
            break
        out = np.argsort(draw.random((many, len(bins))), axis=1)[:, tried:]  # features that a node doesn't try
        best, feature, border = np.full(many, 1e-9), np.full(many, -1), np.zeros(many, dtype=np.int64)
        base = at * BINS
        for f, places in enumerate(bins):
            key = base + places[here]
            left_w, left_s = (np.cumsum(np.bincount(key, x, many * BINS).reshape(many, BINS), axis=1)[:, :-1] for x in (here_w, here_s))
            right_w, right_s = W[:, None] - left_w, S[:, None] - left_s
            fits = (left_w > 1e-9) & (right_w > 1e-9) & ~(out == f).any(axis=1)[:, None]
            gain = np.where(fits, left_s**2 / np.where(fits, left_w, 1) + right_s**2 / np.where(fits, right_w, 1) - (S**2 / np.maximum(W, 1e-300))[:, None], -1.0)
            top = gain.argmax(axis=1)
            gain = gain[np.arange(many), top]
            better = gain > best * (1 + 1e-12)
            best[better], feature[better], border[better] = gain[better], f, top[better]
        tree.feature[heap], tree.border[heap], tree.gain[heap] = feature, border, np.where(feature >= 0, best / np.maximum(W, 1e-300), 0.0)
        inside = np.flatnonzero(node >= first)
        at = node[inside] - first
        split = feature[at] >= 0
        inside, at = inside[split], at[split]
        node[inside] = 2 * node[inside] + 1 + (bins[feature[at], inside] > border[at])
    return tree, node


def boost(bins: np.ndarray, label: np.ndarray, n: np.ndarray, weight: float, trees: int, depth: int, rate: float, seed: int, rows: float = 0.8, share: float = 0.8) -> tuple[list[Tree], np.ndarray]:
    """The trees and each cell's margin; positives have `weight`, negatives 1."""
    draw, y = np.random.default_rng(seed), np.where(label == 1, 1.0, -1.0)
    each, margin, grown = np.where(label == 1, weight, 1.0), np.zeros(len(n)), []
    tried = int(np.ceil(share * len(bins)))
    for k in range(trees):
        some = draw.binomial(n, rows)
        target = y if k == 0 else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
        tree, leaf = _grow(bins, some, some * each, target, depth, tried, draw)
        margin += (1.0 if k == 0 else rate) * tree.value[leaf]
        grown.append(tree)
    return grown, margin


def spark_model(spark, grown: list[Tree], cuts: list[list[float]], rate: float) -> GBTClassificationModel:
    """The trees as Spark's model."""
    gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml
    double, numbers = gateway.jvm.double, spark._jvm.java.nio.ByteBuffer
    # each name below costs calls, so it is looked up once
    calculator, leaf, inner, split = spark._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    splits = [[split(f, border) for border in own] for f, own in enumerate(cuts)]
    regression = ml.regression.DecisionTreeRegressionModel
    roots = gateway.new_array(regression, len(grown))
    for k, tree in enumerate(grown):
        sums = np.stack([tree.weight, tree.weight * tree.value, tree.square], axis=1)
        buffer = numbers.wrap(sums.astype(">f8").tobytes()).asDoubleBuffer()
        variance = tree.square / np.maximum(tree.weight, 1e-300) - tree.value**2

        def made(at: int):
            stats = gateway.new_array(double, 3)
            buffer.position(3 * at)
            buffer.get(stats)
            own = calculator(stats, int(tree.count[at]))
            value, impurity = float(tree.value[at]), float(max(0.0, variance[at]))
            if tree.feature[at] < 0:
                return leaf(value, impurity, own)
            left, right = made(2 * at + 1), made(2 * at + 2)
            return inner(value, impurity, float(tree.gain[at]), left, right, splits[tree.feature[at]][tree.border[at]], own)

        roots[k] = regression(f"dtr_{k}", made(0), len(cuts))
    weights = gateway.new_array(double, len(grown))
    for k in range(len(grown)):
        weights[k] = 1.0 if k == 0 else float(rate)
    java = ml.classification.GBTClassificationModel("linkspan_gbt", roots, weights, len(cuts), 2)
    model = GBTClassificationModel(java)
    model._resetUid(java.uid())
    return model
