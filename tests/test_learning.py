"""Global ranks, the one-pass grid and synthetic rows against plain versions."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from reviewlens.functions.constants import LOGISTIC_GRID
from reviewlens.operators import logistic_grid as G, oversampling as O, ranks


# ranks

def test_running_totals_and_global_rank(spark):
    rows = [(int(i * 7919 % 1000), i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    before, want = 0, {}
    for k, v in sorted(rows):
        want[k] = before
        before += v
    out = ranks.running_totals(df, [F.col("k")], ["v"])
    assert {r.k: r.v_before for r in out.collect()} == want
    assert sorted((r["rank"], r.k) for r in ranks.global_rank(df.select("k"), [F.desc("k")]).collect()) == [
        (i, 999 - i) for i in range(1000)]
    assert ranks.running_totals(df.limit(0), [F.col("k")], ["v"]).count() == 0
    plan = ranks.running_totals(df, [F.col("k")], ["v"])._jdf.queryExecution().executedPlan().toString()
    singles = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(singles) <= 1  # the parts' totals


def test_areas_equal_the_exact_evaluator(spark):
    rng = np.random.default_rng(5)
    rows = [(float(s), float(rng.random() < s / 12), int(m)) for s, m in zip(rng.integers(0, 10, 400), rng.integers(0, 3, 400))]
    df = spark.createDataFrame(rows, "score double, label double, m int")
    for metric, name in (("areaUnderROC", "area_under_roc"), ("areaUnderPR", "area_under_pr")):
        want = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName=metric, numBins=0).evaluate(df)
        assert ranks.areas(df, "score").first()[name] == pytest.approx(want, abs=1e-12)
    by = {r.m: r.area_under_roc for r in ranks.areas_by(df, "m", "score").collect()}
    for m in range(3):
        assert by[m] == pytest.approx(ranks.areas(df.where(F.col("m") == m), "score").first()[0], abs=1e-12)
    empty = ranks.areas(df.where("label = 1"), "score").first()
    assert empty.area_under_roc is None and empty.area_under_pr == 1.0


# logistic grid

def vectors(spark, n=300, size=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * np.array([1, 10, 0.1, 1, 1, 5, 1, 1])[:size] + 3
    x[:, 4] = 2.0  # no spread
    y = (x[:, 0] + 0.2 * x[:, 1] - 5 * x[:, 2] + rng.normal(0, 2, n) > np.median(x[:, 0] + 0.2 * x[:, 1] - 5 * x[:, 2])).astype(float)
    rows = [(i, float(b), i * 31 % 3, [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, label double, fold int, v array<double>")
    return df.select("i", "label", "fold", array_to_vector("v").alias("features")).checkpoint()


def test_one_fit_equals_the_library(spark):
    df = vectors(spark)
    rows = G.grid_rows(df, "features", "label", F.lit(0)).checkpoint()
    for reg, mix in ((0.1, 0.0), (0.01, 0.2), (0.001, 0.1)):
        model = LogisticRegression(regParam=reg, elasticNetParam=mix, maxIter=200, tol=1e-10).fit(df)
        found, _ = G.fit(rows, [G.Problem(reg, mix, None)], [200])
        assert found[0][200][:-1] == pytest.approx(model.coefficients.toArray(), abs=2e-3 * np.abs(model.coefficients.toArray()).max())
        assert found[0][200][-1] == pytest.approx(model.intercept, abs=2e-2)


def test_grid_equals_81_fits(spark):
    df = vectors(spark)
    lr = LogisticRegression()
    grid = (ParamGridBuilder().addGrid(lr.maxIter, LOGISTIC_GRID["maxIter"]).addGrid(lr.regParam, LOGISTIC_GRID["regParam"])
            .addGrid(lr.elasticNetParam, LOGISTIC_GRID["elasticNetParam"]).build())
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, numFolds=3, foldCol="fold", parallelism=4,
                        evaluator=BinaryClassificationEvaluator(numBins=0)).fit(df)
    rows = G.grid_rows(df, "features", "label", F.col("fold")).repartition(3).checkpoint()
    found, passes = G.cross_validate(rows, LOGISTIC_GRID["regParam"], LOGISTIC_GRID["elasticNetParam"], LOGISTIC_GRID["maxIter"], 3)
    assert len(found) == 27 and passes < 81
    for params, auc in zip(cv.getEstimatorParamMaps(), cv.avgMetrics):
        p = {k.name: v for k, v in params.items()}
        assert found[p["maxIter"], p["regParam"], p["elasticNetParam"]] == pytest.approx(auc, abs=1e-3)


def test_grid_passes_read_blocks_of_rows(spark):
    df = vectors(spark)
    rows = G.grid_rows(df, "features", "label", F.col("fold")).repartition(3).checkpoint()
    packed = G.blocks(rows).checkpoint()
    assert packed.count() == 3  # and not one row for each of them
    got = sorted((y, f, tuple(x)) for r in packed.collect() for y, f, x in zip(
        np.frombuffer(r.y), np.frombuffer(r.fold, np.int64), np.frombuffer(r.x).reshape(-1, r.width)))
    assert got == sorted((r.y, r.fold, tuple(r.x)) for r in rows.collect())
    problems = [G.Problem(0.01, 0.1, 1), G.Problem(0.1, 0.0, None)]
    for a, b in zip(G.fit(packed, problems, [5])[0], G.fit(rows, problems, [5])[0]):
        assert np.allclose(a[5], b[5])


def test_margin_column(spark):
    df = vectors(spark, 10)
    w = np.arange(9, dtype=float)
    got = df.select(G.margin(vector_to_array("features"), w).alias("m"), vector_to_array("features").alias("x")).collect()
    assert all(r.m == pytest.approx(np.dot(r.x, w[:-1]) + w[-1]) for r in got)


# oversampling

def clustered(spark, n, seed=2, size=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, size))[rng.integers(0, 40, n)] * 3 + rng.normal(size=(n, size))
    return x, spark.createDataFrame([(f"r{i:05d}", [float(v) for v in a]) for i, a in enumerate(x)], "id string, x array<double>")


def brute_neighbours(x, k):
    d = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("n,bucket_rows,least", [(150, 2000, 1.0), (2000, 300, 0.9)])
def test_neighbours_against_brute_force(spark, n, bucket_rows, least):
    x, df = clustered(spark, n)
    got = {}
    for r in O.neighbours(df, 5, bucket_rows=bucket_rows).collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
    want = brute_neighbours(x, 5)
    hit = sum(len(got[i] & set(row.tolist())) for i, row in enumerate(want)) / want.size
    assert len(got) == n and all(len(v) == 5 for v in got.values()) and hit >= least


def test_oversampling_balances_and_repeats_exactly(spark):
    x, df = clustered(spark, 260)
    rows = df.select("id", F.when(F.col("id") < "r00037", 1.0).when(F.col("id") < "r00200", 0.0).when(F.col("id") < "r00255", 2.0)
                     .alias("label"), array_to_vector("x").alias("features"))
    runs = []
    for parts in (1, 6):
        out = O.oversample(rows.repartition(parts), "id").select("*", vector_to_array("features").alias("x")).collect()
        runs.append(sorted((r.id, r.label, tuple(r.x), r.synthetic) for r in out if r.id is not None))
    assert runs[0] == runs[1]
    assert len({r.id for r in out}) == len(out)
    by = {}
    for r in out:
        by[r.label] = by.get(r.label, 0) + 1
    assert by == {1.0: 163, 0.0: 163, 2.0: 163, None: 5}
    at = {f"r{i:05d}": a for i, a in enumerate(x)}
    near = brute_neighbours(x[:37], 5)
    for r in out:
        if r.synthetic:
            assert 0 <= r.share < 1 and r.label in (1.0, 2.0)
            assert np.allclose(r.x, at[r.base] + r.share * (at[r.other] - at[r.base]))
            if r.label == 1.0:
                assert int(r.other[1:]) in near[int(r.base[1:])]


def test_oversampling_odd_tables(spark):
    one = spark.createDataFrame([("a", 1.0, [1.0]), ("b", 0.0, [2.0]), ("c", 0.0, [3.0])], "id string, label double, v array<double>")
    out = O.oversample(one.select("id", "label", array_to_vector("v").alias("features")), "id").collect()
    assert [(r.base, r.other, r.features[0]) for r in out if r.synthetic] == [("a", "a", 1.0)]
    empty = one.select("id", "label", array_to_vector("v").alias("features")).limit(0)
    assert O.oversample(empty, "id").count() == 0
