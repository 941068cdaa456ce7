"""Plan-shape checks: the scale properties the design relies on."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import SF_SMALL  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _plan(df) -> str:
    """Final (adaptive) physical plan: the DataFrame's own execution is run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_flagship_scan_is_pruned(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["e5_helpful_rate_by_length"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    docs = [s for s in schemas if "text" in s]
    assert docs and all(set(x.split(":")[0] for x in s.split(",")) <= {"doc_id", "text", "lang", "source"} for s in docs)


def test_null_drop_is_pushed_to_the_scan(spark):
    from reviewlens.operators import prep
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = _plan(prep.drop_missing(df, ["text"]))
    assert "IsNotNull(text)" in plan


def test_dedup_limits_before_the_shuffle(spark):
    from reviewlens.operators import prep
    from reviewlens.sources import reviews_from_lineitems
    plan = _plan(prep.dedup_latest(reviews_from_lineitems(spark, SF_SMALL), ["reviewerID", "asin"]))
    partial = plan.find("WindowGroupLimit")
    assert "Partial" in plan and "Final" in plan
    # the partial limit sits below (after, in the string) the dedup exchange
    assert plan.rfind("WindowGroupLimit") > plan.find("Exchange hashpartitioning(reviewerID") > partial


def test_recency_window_reuses_join_partitioning(spark):
    from reviewlens.operators import features
    rows = [(f"r{i}", "hot" if i % 4 else "p1", f"2020-01-0{1 + i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "reviewID string, productId string, d string") \
        .withColumn("reviewTime", F.to_date("d")).drop("d")
    # the large-scale shape: no broadcast, so the offsets join is a sort-merge join
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(features.recency_order(df))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    top = plan[:plan.find("SortMergeJoin")]
    assert "SortMergeJoin" in plan and "Window" in top and "Exchange" not in top


def test_small_lexicon_is_broadcast(spark):
    from reviewlens.operators import sentiment
    docs = spark.createDataFrame([("a", "good day"), ("b", "bad day")], "reviewID string, reviewTot string")
    lex = spark.createDataFrame([("good", 1.0, 0.5, 0.5)], "token string, valence double, polarity double, subjectivity double")
    plan = _plan(sentiment.sentiment_scores(docs, lex))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _exchanged_columns(plan: str) -> list[str]:
    """What each hash exchange carries: the columns of the projection or aggregate nearest below it."""
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next((x for x in lines[i + 1:] if re.search(r"(Project|HashAggregate) ?[\[(]", x)), "")
            out.append(below.split("functions=")[0])
    return out


def _output_names(node: str) -> set[str]:
    """Columns that come out of a printed projection: arguments inside parentheses do not count."""
    flat, depth = [], 0
    for ch in node[node.index("[") + 1:] if "[" in node else "":
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            flat.append(ch)
    return {m for part in "".join(flat).split(", ") for m in re.findall(r"([A-Za-z_]+)#\d+L?\]?$", part.strip())}


def test_no_text_in_the_exchanges_of_the_studies(spark):
    import __spark_entry__ as E
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("e5_helpful_rate_by_length", "a7_a8_a9_length_summary", "z1_z3_sentiment_scores"):
            carried = _exchanged_columns(_plan(E.queries()[name](spark, SF_SMALL)))
            assert len(carried) >= 3, name
            for cols in carried:
                names = _output_names(cols)
                assert not names & {"text", "reviewText", "summary", "reviewTot", "combined_text"}, (name, cols)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_token_queries_do_not_read_labels(spark):
    import __spark_entry__ as E
    for name in ("n1_regex_tokens", "n5_term_frequency_vocabulary", "n8_string_index_reviewers", "n13_marked_unknown_words"):
        assert "labels.parquet" not in _plan(E.queries()[name](spark, SF_SMALL)), name


def test_offsets_have_one_row_a_product(spark):
    """Normal products are one slice; the dedup is planned once."""
    from reviewlens.operators import features, prep
    from reviewlens.sources import reviews_from_lineitems
    r = prep.add_review_dates(prep.dedup_latest(reviews_from_lineitems(spark, SF_SMALL), ["reviewerID", "asin"]))
    keyed = features._product_keys(r, "asin")
    sizes = keyed.groupBy("_kp", "_np").agg(F.count(F.lit(1)).alias("_rows"), F.max("reviewTime").alias("_latest"))
    sliced = features._sliced(keyed, sizes, "reviewTime", "reviewID", features.SLICE_ROWS)
    assert features._offsets(sliced).count() == r.select("asin").distinct().count()
