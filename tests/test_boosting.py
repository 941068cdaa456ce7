"""Leaf-wise boosted trees against a plain single-process version, tree by tree."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from reviewlens.operators import boosting as B
from reviewlens.plans import models


def plain_trees(x, y, s, rounds):
    """Grows each tree one split at a time: the leaf with the best split first."""
    edges = [sorted({sorted(col)[min(len(col) - 1, max(0, math.ceil(k / s.max_bins * len(col)) - 1))]
                     for k in range(1, s.max_bins)}) for col in x.T.tolist()]
    bins = np.array([[sum(e < v for e in own) for own, v in zip(edges, row)] for row in x.tolist()])
    margin = np.full(len(y), math.log(y.sum() / (len(y) - y.sum())))
    out = []

    def l1(g):
        return math.copysign(max(abs(g) - s.lambda_l1, 0.0), g)

    def best(rows, g, h, features):
        found = None
        total_g, total_h = int(g[rows].sum()), int(h[rows].sum())
        for f in features:
            for b in range(s.max_bins - 1):
                low = rows[bins[rows, f] <= b]
                n, gl, hl = len(low), int(g[low].sum()), int(h[low].sum())
                if min(n, len(rows) - n) < s.min_rows or min(hl, total_h - hl) < s.min_hessian * B.UNIT:
                    continue
                parts = [(gl, hl), (total_g - gl, total_h - hl), (total_g, total_h)]
                a, c, p = (l1(u / B.UNIT) ** 2 / (v / B.UNIT + s.lambda_l2) for u, v in parts)
                if a + c - p > 0 and (found is None or a + c - p > found[0]):
                    found = (a + c - p, f, b)
        return found
    for t in range(rounds):
        features = B.sampled_features(x.shape[1], t, s)
        g, h = B.gradients(y, margin)
        leaves = {(): np.arange(len(y))}
        splits = {(): best(leaves[()], g, h, features)}
        tree = {}
        while len(leaves) < s.num_leaves and any(splits[p] for p in leaves):
            path = min((p for p in leaves if splits[p]), key=lambda p: (-splits[p][0], p))
            gain, f, b = splits[path]
            rows = leaves.pop(path)
            tree[path] = (f, b)
            for side, part in ((0, rows[bins[rows, f] <= b]), (1, rows[bins[rows, f] > b])):
                leaves[path + (side,)] = part
                splits[path + (side,)] = best(part, g, h, features)
        if not tree:
            break
        for path, rows in leaves.items():
            value = -l1(int(g[rows].sum()) / B.UNIT) / (int(h[rows].sum()) / B.UNIT + s.lambda_l2) * s.learning_rate
            margin[rows] += value
            tree[path] = value
        out.append(tree)
    return out, margin


def as_paths(tree):
    out, stack = {}, [(0, ())]
    while stack:
        k, path = stack.pop()
        if tree.feature[k] >= 0:
            out[path] = (int(tree.feature[k]), int(tree.bin[k]))
            stack += [(int(tree.left[k]), path + (0,)), (int(tree.right[k]), path + (1,))]
        else:
            out[path] = float(tree.value[k])
    return out


def data(n=200, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = (x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(0, 0.5, n) > 0.3).astype(float)
    return x, y


def frame(spark, x, y):
    rows = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "label double, v array<double>")
    return rows.select("label", array_to_vector("v").alias("features"))


@pytest.mark.parametrize("settings", [B.Settings(rounds=4, min_rows=5, num_leaves=12, lambda_l1=0.1, learning_rate=0.3),
                                      B.Settings(rounds=3, max_bins=16, feature_fraction=0.5)])
def test_equals_the_plain_version_tree_by_tree(spark, settings):
    x, y = data()
    want, margin = plain_trees(x, y, settings, settings.rounds)
    for parts in (1, 5):  # whole-number sums: the same trees on any partitioning
        model = B.fit(frame(spark, x, y).repartition(parts), settings)
        got = [as_paths(t) for t in model.trees]
        assert [{k: v for k, v in t.items() if isinstance(v, tuple)} for t in got] == [
            {k: v for k, v in t.items() if isinstance(v, tuple)} for t in want]
        for a, b in zip(got, want):
            assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a if not isinstance(a[k], tuple))
    assert np.allclose(model.margins(x), margin)


def test_more_trees_than_a_checkpoint_holds(spark, monkeypatch):
    x, y = data(120)
    s = B.Settings(rounds=5, min_rows=5)
    df = frame(spark, x, y)
    whole = B.fit(df, s)
    monkeypatch.setattr(B, "CHECKPOINT_TREES", 2)
    assert [as_paths(t) for t in B.fit(df, s).trees] == [as_paths(t) for t in whole.trees]


def test_transform_importances_and_frame(spark):
    x, y = data(300)
    model = B.fit(frame(spark, x, y), B.Settings(rounds=20, min_rows=10))
    out = model.transform(frame(spark, x, y).withColumn("p", F.lit(1))).select(
        "label", "p", "prediction", vector_to_array("probability").alias("q")).collect()
    assert all(abs(sum(r.q) - 1) < 1e-12 and r.prediction == float(r.q[1] > 0.5) for r in out)
    assert sum(r.prediction == r.label for r in out) > 240
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)
    assert model.frame(spark).filter("feature < 0").groupBy("tree").count().agg(F.max("count")).first()[0] <= 50
    assert models.feature_importances(spark, model, list("abcde")).count() == 5


def test_one_class_no_rows_and_missing_values(spark):
    x, y = data(60)
    for rows, p in ((frame(spark, x, np.ones(60)), 0.99), (frame(spark, x, y).limit(0), 0.5)):
        model = B.fit(rows)
        assert model.trees == []
        got = model.transform(frame(spark, x, y).limit(3)).select(vector_to_array("probability")[1].alias("p")).collect()
        assert all(r.p >= p - 1e-9 for r in got) if p != 0.5 else all(r.p == 0.5 for r in got)
    x[:10, 0] = np.nan
    assert B.fit(frame(spark, x, y), B.Settings(rounds=2, min_rows=5)).trees
