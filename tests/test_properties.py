"""Property tests (hypothesis) on small frames."""

from hypothesis import given, settings, strategies as st

from reviewlens.functions import bins
from reviewlens.operators import eda, prep

FAST = settings(max_examples=6, deadline=None)
finite = st.floats(min_value=-1.0, max_value=1.0, allow_nan=False, width=32)


@FAST
@given(st.lists(finite, min_size=1, max_size=40))
def test_compound_bins_partition_and_are_monotone(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x float")
    got = [(r.x, int(r.b)) for r in df.select("x", bins.compound_bin("x").alias("b")).collect()]
    assert all(1 <= b <= 8 for _, b in got)
    got.sort()
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))


@FAST
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=20))
def test_histogram_counts_sum_to_n(spark, xs, nbins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = eda.histogram(df, "x", nbins).collect()
    assert len(h) == nbins and sum(r["count"] for r in h) == len(xs)


keys = st.lists(st.tuples(st.sampled_from(["u1", "u2", None]), st.sampled_from(["p1", "p2"]),
                          st.integers(min_value=0, max_value=3)), min_size=1, max_size=30)


@FAST
@given(keys)
def test_dedup_idempotent_and_order_independent(spark, rows):
    data = [(f"r{i}", u, p, t) for i, (u, p, t) in enumerate(rows)]
    schema = "reviewID string, reviewerID string, asin string, unixReviewTime long"
    a = prep.dedup_latest(spark.createDataFrame(data, schema), ["reviewerID", "asin"])
    b = prep.dedup_latest(spark.createDataFrame(list(reversed(data)), schema).repartition(3), ["reviewerID", "asin"])
    ra, rb = sorted(a.collect()), sorted(b.collect())
    assert ra == rb
    assert sorted(prep.dedup_latest(a, ["reviewerID", "asin"]).collect()) == ra
    assert a.select("reviewerID", "asin").distinct().count() == a.count()


words = st.sampled_from(["good", "bad", "fine", "not", "very", "zzz", "no", "barely"])


@FAST
@given(st.lists(st.lists(words, max_size=12), min_size=1, max_size=12), st.integers(min_value=1, max_value=5))
def test_sentiment_independent_of_partitioning(spark, docs, parts):
    from reviewlens.operators import sentiment
    lex = spark.createDataFrame([("good", 2.0, 0.7, 0.6), ("bad", -2.0, -0.7, 0.7), ("fine", 1.1, 0.3, 0.1)],
                                "token string, valence double, polarity double, subjectivity double")
    rows = [(f"d{i}", " ".join(w), i % 2) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "reviewID string, reviewTot string, label int")
    def scored(x):
        return sorted(sentiment.add_sentiment(x.drop("reviewTot"), sentiment.sentiment_scores(x, lex)).collect())
    a, b = scored(df), scored(df.repartition(parts))
    assert a == b and len(a) == len(rows)


@FAST
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=40))
def test_count_join_back_matches_window_count(spark, ks):
    from pyspark.sql import Window, functions as F
    from reviewlens.operators import features
    df = spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "i int, k string")
    got = {r.i: r.n for r in features.add_group_count(df, "k", "n").collect()}
    want = {r.i: (r.w if r.k is not None else None)
            for r in df.withColumn("w", F.count(F.lit(1)).over(Window.partitionBy("k"))).collect()}
    assert got == want
