"""Operator semantics on small hand-made frames."""

import math

from pyspark.sql import Window, functions as F

from reviewlens.operators import eda, features, metrics, prep, sentiment, tokens


def test_left_join_null_key_gets_null_count(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    got = sorted((r.k or "", r.n) for r in features.add_group_count(df, "k", "n").collect())
    assert got == [("", None), ("a", 2), ("a", 2)]


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, y int")
    assert df.select(eda.safe_corr("x", "y").alias("c")).first().c is None


def test_minmax_constant_column(spark):
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    v = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df)
    out = MinMaxScaler(inputCol="v", outputCol="s").fit(v).transform(v).collect()
    assert [r.s[0] for r in out] == [0.5, 0.5]


def test_dedup_latest_deterministic(spark):
    rows = [("r1", "u", "p", 10), ("r2", "u", "p", 20), ("r3", "u", "p", 20), ("r4", "v", "p", 5)]
    df = spark.createDataFrame(rows, "reviewID string, reviewerID string, asin string, unixReviewTime long")
    got = sorted(r.reviewID for r in prep.dedup_latest(df, ["reviewerID", "asin"]).collect())
    assert got == ["r2", "r4"]


def test_recency_order_matches_flat_window_with_hot_product(spark):
    rows = [(f"r{i:03d}", "hot" if i % 3 else f"p{i % 5}", f"2020-01-{1 + i % 7:02d}") for i in range(120)]
    rows.append(("rnull", None, "2020-01-01"))
    df = spark.createDataFrame(rows, "reviewID string, productId string, d string") \
        .withColumn("reviewTime", F.to_date("d")).drop("d")
    flat = df.withColumn("expected", F.row_number().over(
        Window.partitionBy("productId").orderBy(F.desc("reviewTime"), F.md5("reviewID"), "reviewID")))
    for slice_rows in (1, 7, 1000):  # hot products cut into many slices, a few, none
        got = features.recency_order(flat, slice_rows=slice_rows)
        assert got.where(F.col("reviewOrder") != F.col("expected")).count() == 0
        assert got.count() == df.count()


def test_product_features_inner_drops_null_product(spark):
    rows = [("r1", "u1", "p", "2020-01-01"), ("r2", "u2", "p", "2020-01-05"), ("r3", "u3", None, "2020-01-02")]
    df = spark.createDataFrame(rows, "reviewID string, reviewerID string, productId string, d string") \
        .withColumn("reviewTime", F.to_date("d")).drop("d")
    out = {r.reviewID: r for r in features.product_features(df, deduplicated=True).collect()}
    assert set(out) == {"r1", "r2"}
    assert out["r2"].reviewOrder == 1 and out["r1"].reviewOrder == 2
    same_day = [("a", "u1", "p", "2020-01-01"), ("b", "u2", "p", "2020-01-01"), ("c", "u3", "p", "2020-01-01")]
    sd = spark.createDataFrame(same_day, "reviewID string, reviewerID string, productId string, d string") \
        .withColumn("reviewTime", F.to_date("d")).drop("d")
    order = [r.reviewID for r in features.product_features(sd, deduplicated=True).orderBy("reviewOrder").collect()]
    import hashlib
    assert order == sorted(["a", "b", "c"], key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert out["r1"].product_review_interval == 4 and out["r1"].reviews_per_product == 2


def _lexicon(spark):
    return spark.createDataFrame([("good", 2.0, 0.7, 0.6), ("bad", -2.0, -0.7, 0.7), ("fine", 1.0, 0.4, 0.2)],
                                 "token string, valence double, polarity double, subjectivity double")


def test_sentiment_semantics(spark):
    docs = spark.createDataFrame([("a", "good"), ("b", "not good"), ("c", "very good"), ("d", "nothing here"),
                                  ("e", "not so very good"), ("f", "")], "reviewID string, reviewTot string")
    scores = sentiment.sentiment_scores(docs, _lexicon(spark))
    got = {r.reviewID: r for r in sentiment.add_sentiment(docs, scores).collect()}
    comp = lambda s: s / math.sqrt(s * s + 15)
    assert abs(got["a"].compound_score - comp(2.0)) < 1e-6
    assert abs(got["b"].compound_score - comp(-0.74 * 2.0)) < 1e-6
    assert abs(got["c"].compound_score - comp(2.293)) < 1e-6
    assert got["d"].compound_score == 0.0 and got["f"].compound_score == 0.0
    # negation three tokens back, booster right before
    assert abs(got["e"].compound_score - comp(-0.74 * 2.293)) < 1e-6
    assert abs(got["b"].polarity_score - (-0.35)) < 1e-6
    assert abs(got["a"].sentiment_score - 0.6) < 1e-6
    assert len(got) == 6


def _compound(spark, text, lexicon=None, **kw):
    docs = spark.createDataFrame([("a", text)], "reviewID string, reviewTot string")
    rows = sentiment.sentiment_scores(docs, lexicon or _lexicon(spark), **kw).collect()
    return rows[0].compound_score if rows else 0.0


def test_contractions_negate(spark):
    plain = _compound(spark, "dont feel good")
    assert plain < 0
    for text in ("don't feel good", "don\u2019t feel good", "It isn't good", "I can't call it good"):
        assert abs(_compound(spark, text) - plain) < 1e-6, text


def test_modifiers_are_a_table(spark):
    mods = spark.createDataFrame([("hyper", "boost", 1.0), ("hyper", "boost", 0.5), ("un", "negate", None)],
                                 "token string, kind string, weight double")
    comp = lambda s: s / math.sqrt(s * s + 15)
    assert abs(_compound(spark, "hyper good", modifiers=mods) - comp(3.0)) < 1e-6
    assert abs(_compound(spark, "un good", modifiers=mods) - comp(-0.74 * 2.0)) < 1e-6
    assert abs(_compound(spark, "not good", modifiers=mods) - comp(2.0)) < 1e-6


def test_emphasis_and_contrast(spark):
    comp = lambda s: s / math.sqrt(s * s + 15)
    for text, want in (("good!", 2.0 + 0.292), ("good !!!!!!", 2.0 + 4 * 0.292), ("bad!!", -2.0 - 2 * 0.292),
                       ("good?", 2.0), ("good??", 2.0 + 0.36), ("bad???", -2.0 - 0.54), ("good?????", 2.0 + 0.96),
                       ("bad, but good", -1.0 + 3.0), ("But good", 3.0), ("good but", 1.0), ("good but bad but fine", 1.0 - 3.0 + 1.5),
                       ("good but not fine!", 1.0 - 0.74 * 1.5 - 0.292), ("fine but bad?!", 0.5 - 3.0 - 0.292)):
        assert abs(_compound(spark, text) - comp(want)) < 1e-6, text
    assert _compound(spark, "!!! nothing") == 0.0


def test_persisted_rows_are_released(spark):
    empty = spark._jsparkSession.sharedState().cacheManager()
    df = spark.range(100).selectExpr("id * 2 as x")
    with prep.persisted(df) as kept:
        assert kept.count() == 100 and not empty.isEmpty()
    assert empty.isEmpty()
    try:
        with prep.persisted(df) as kept:
            kept.count()
            raise KeyError
    except KeyError:
        pass
    assert empty.isEmpty()


def test_repeated_lexicon_entries_count_once(spark):
    twice = _lexicon(spark).union(_lexicon(spark))
    assert _compound(spark, "good", twice) == _compound(spark, "good")


def test_repeated_review_ids_are_refused(spark):
    import pytest
    from reviewlens.plans import studies
    rows = [("a", "u", "p", "good", None, True, 1.0, 10, 1), ("a", "v", "p", "bad", None, True, 1.0, 11, 0)]
    df = spark.createDataFrame(rows, "reviewID string, reviewerID string, asin string, reviewText string, summary string, "
                                     "verified boolean, overall double, unixReviewTime long, label int")
    with pytest.raises(ValueError, match="must be unique"):
        studies.sentiment_study(df, _lexicon(spark))
    with pytest.raises(ValueError, match="must be unique"):
        studies.build_features(df, _lexicon(spark))


def test_feature_build_with_nulls(spark):
    from reviewlens.plans import studies, textml
    rows = [("a", "u", "p", "good day", None, None, None, 10, 1), ("b", "v", "p", None, "x", True, 2.0, 11, 0),
            ("c", "w", "q", "bad", "y", False, 3.0, 12, None), ("d", None, "q", "fine", "z", True, 4.0, 13, 1)]
    df = spark.createDataFrame(rows, "reviewID string, reviewerID string, asin string, reviewText string, summary string, "
                                     "verified boolean, overall double, unixReviewTime long, label int")
    train = {r.reviewID: r for r in studies.build_features(df, _lexicon(spark)).collect()}
    assert set(train) == {"a", "d"} and train["a"].overall == 0.0 and train["a"].verified == 0
    score = {r.reviewID: r for r in studies.build_features(df.drop("label"), _lexicon(spark), "score").collect()}
    assert set(score) == {"a", "b", "c", "d"} and score["b"].combined_text == "x"
    import pytest
    with pytest.raises(Exception, match="null"):
        textml.assembler(["overall"], "v").transform(df.select("overall")).collect()


def test_quality_report_and_row_counts_keep_null_keys(spark):
    df = spark.createDataFrame([("u", "p"), (None, "p"), (None, "p"), ("u", None)], "a string, b string")
    r = prep.quality_report(df, ["a", "b"], ["a"]).first()
    kept = prep.dedup_latest(df.withColumns({"unixReviewTime": F.lit(1), "reviewID": F.lit("x")}), ["a", "b"]).count()
    assert (r.rows, r.distinct_keys, r.null_a) == (4, 3, 2) and kept == 3
    c = prep.dedup_row_counts(df, ["a", "b"]).first()
    assert (c.rows_before, c.rows_after) == (4, 3)
    assert prep.drop_columns(df, ["b", "nothing"]).columns == ["a"]


def test_lemma_with_two_rows_adds_no_token(spark):
    df = spark.createDataFrame([("d", ["cats", "run"])], "id string, toks array<string>")
    lem = spark.createDataFrame([("cats", "catt"), ("cats", "cat")], "form string, lemma string")
    assert tokens.lemmatize(df, lem, "id", "toks").first().lemmas == ["cat", "run"]


def test_frequency_index_matches_a_flat_ranking(spark):
    vals = ["b"] * 3 + ["a"] * 3 + ["zz"] * 5 + [f"v{i:03d}" for i in range(300)] + ["é", "", None, None]
    df = spark.createDataFrame([(v,) for v in vals], "k string")
    from collections import Counter
    counts = Counter(v for v in vals if v is not None)
    want = {v: i for i, (v, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())))}
    assert {r.k: r["index"] for r in tokens.frequency_index(df, "k").collect()} == want


def test_accuracy_counts_any_label_and_report_refuses_others(spark):
    import pytest
    df = spark.createDataFrame([(1, 1), (2, 2), (0, 1), (None, 1)], "label int, prediction int")
    assert abs(metrics.accuracy(df).first().accuracy - 2 / 3) < 1e-12
    with pytest.raises(Exception, match="must be 0 or 1"):
        metrics.confusion_matrix(df).collect()
    with pytest.raises(Exception, match="must be 0 or 1"):
        metrics.classification_report(df).collect()


def test_lemmatize_and_mark_unknown_keep_order(spark):
    df = spark.createDataFrame([("d1", ["cats", "run", "dogs"], "Cats run Fast"), ("d2", [], "")],
                               "id string, toks array<string>, txt string")
    lem = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    got = {r.id: r.lemmas for r in tokens.lemmatize(df, lem, "id", "toks").collect()}
    assert got == {"d1": ["cat", "run", "dog"], "d2": []}
    words = spark.createDataFrame([("cats",), ("run",)], "word string")
    got = {r.id: r.marked_text for r in tokens.mark_unknown(df, words, "id", "txt").collect()}
    assert got == {"d1": "Cats run [Fast]", "d2": ""}


def test_vocabulary_and_idf_match_ml(spark):
    from pyspark.ml.feature import IDF, CountVectorizer
    docs = [(f"d{i}", ["a", "b"] + (["c"] if i % 2 else []) + (["d"] * 3 if i % 3 == 0 else [])) for i in range(12)]
    df = spark.createDataFrame(docs, "id string, toks array<string>")
    vocab = tokens.vocabulary(df, "id", "toks", vocab_size=10, min_df=2, max_df=0.9)
    cv = CountVectorizer(inputCol="toks", outputCol="tf", vocabSize=10, minDF=2, maxDF=0.9).fit(df)
    assert sorted(r.term for r in vocab.collect()) == sorted(cv.vocabulary)
    idf = {r.term: r.idf for r in tokens.inverse_document_frequency(vocab, F.lit(12), 1).collect()}
    model = IDF(inputCol="tf", outputCol="w", minDocFreq=1).fit(cv.transform(df))
    for term, w in zip(cv.vocabulary, model.idf.toArray()):
        assert abs(idf[term] - w) < 1e-9


def test_confusion_report_and_auc(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.8), (0, 0, 0.4)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    cm = {(r.label, r.predicted): r.n for r in metrics.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert abs(rep["1"].precision - 2 / 3) < 1e-9 and abs(rep["accuracy"].f1_score - 4 / 6) < 1e-9
    assert rep["weighted avg"].support == 6
    # ranks: positives 0.9, 0.4, 0.8 vs negatives 0.1, 0.6, 0.4 -> (3 + 0.5 + 2 + 3) / 9
    assert abs(metrics.area_under_roc(df, "score") - (3 + 1.5 + 3) / 9) < 1e-9


def test_histogram_keeps_all_rows_and_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 2, 10]], "x double")
    h = eda.histogram(df, "x", 5).collect()
    assert len(h) == 5 and sum(r["count"] for r in h) == 5 and h[-1]["count"] == 1
    const = eda.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).collect()
    assert sum(r["count"] for r in const) == 2


def test_term_counts_shuffle_terms_only_and_ids_that_repeat_are_one_document(spark):
    from pyspark.sql import functions as F
    from reviewlens.operators import tokens
    rows = [(i, [f"w{i % 3}", "x", "x"]) for i in range(12)] + [(3, ["x", "y"]), (20, []), (21, None), (None, ["y"]), (None, ["y"])]
    for own in (rows[:12], rows):
        df = spark.createDataFrame(own, "id int, toks array<string>")
        docs = {}
        for i, t in own:
            docs.setdefault(i, []).extend(t or [])
        want = {t: (sum(t in d for d in docs.values()), sum(d.count(t) for d in docs.values())) for d in docs.values() for t in d}
        got = tokens.term_frequencies(df, "id", "toks")
        assert {r.term: (r.doc_freq, r.term_freq) for r in got.collect()} == want
        if own is not rows:
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
        vocab = tokens.vocabulary(df, "id", "toks", vocab_size=10, min_df=1, max_df=1.0).checkpoint()
        idf = tokens.inverse_document_frequency(vocab, df.select(F.count(F.lit(1))).scalar(), 1)
        cells = tokens.tf_idf_scaled(df, vocab, idf, "id", "toks")
        weight = {r.term: r.idf for r in idf.collect()}
        found = {(r.id, r.term): (r.tf_idf, r.scaled) for r in cells.collect()}
        assert found.keys() == {(i, t) for i, d in docs.items() for t in d if t in weight} and len(found) == cells.count()
        assert all(found[i, t][0] == docs[i].count(t) * weight[t] and 0 <= found[i, t][1] <= 1 for i, t in found)
        assert "SortMergeJoin" not in cells._jdf.queryExecution().executedPlan().toString()


def test_class_weights_do_not_shuffle_the_rows_and_fits_get_small_partitions(spark):
    from reviewlens.plans import models
    df = spark.createDataFrame([(k, float(k % 4 == 0)) for k in range(40)], "k int, label double").repartition(2).checkpoint()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = models.class_weights(df)
        assert {(r.label, r.class_weight) for r in out.collect()} == {(1.0, 2.0), (0.0, 40 / 60)}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    wide = models.spread(df, 5)
    assert wide.rdd.getNumPartitions() == 8 and wide.count() == 40 and models.spread(df, 20) is df


def test_vectors_are_kept_without_texts_and_word_training_is_bounded_by_the_cores(spark):
    from reviewlens.functions.constants import FEATURE_COLUMNS
    from reviewlens.plans import scoring, textml
    plain = [c for c in FEATURE_COLUMNS if c != "word2vec_features"]
    rows = [(str(k), k % 2, "good old words here " * 3, *[float(k % 5 + j) for j in range(len(plain))]) for k in range(40)]
    df = spark.createDataFrame(rows, "reviewID string, label int, combined_text string, " + ", ".join(f"{c} double" for c in plain))
    v = scoring.vectorize(df)
    assert v.train.count() + v.holdout.count() == 40
    assert not {"combined_text", "words", "filtered"} & {*v.train.columns, *v.holdout.columns}
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        assert textml.word2vec().getNumPartitions() == textml.WAVES * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_word_training_sends_one_set_of_vectors_a_core(spark):
    from reviewlens.plans import textml
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        assert textml.word2vec().getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_texts_are_cleaned_behind_the_join(spark):
    from reviewlens.plans import studies
    texts = spark.createDataFrame([("a", "Good -- it's 12!", None), ("b", None, "x"), ("c", "gone", "gone")],
                                  "reviewID string, reviewText string, summary string")
    out = studies.with_cleaned_texts(spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "reviewID string, n int"), texts)
    assert {tuple(r) for r in out.collect()} == {("a", 1, "good its  "), ("b", 2, "x")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Join")


def test_token_context_is_compiled_with_the_explode(spark):
    from reviewlens.operators import sentiment
    df = spark.createDataFrame([("a", "not a very good day, but wasn't bad"), ("b", None), ("c", "")], "reviewID string, reviewTot string")
    out = sentiment.lexicon_tokens(df, "reviewID", "reviewTot")
    rows = [tuple(r) for r in out.orderBy("reviewID", "pos").select("reviewID", "pos", "tok", "negated", "boost").collect()]
    assert [(r[1], r[2], r[3]) for r in rows] == [(0, "not", False), (1, "a", True), (2, "very", True), (3, "good", True), (4, "day", False),
                                                  (5, "but", False), (6, "wasnt", False), (7, "bad", True)]
    assert {r[0] for r in rows} == {"a"} and rows[3][4] > 0 and rows[4][4] == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # an interpreted step for every token
