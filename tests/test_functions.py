"""Hand fixtures for the scalar functions (FIXTURES.md section 4)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import bins, dates, text
from reviewlens.functions.stopwords import ENGLISH_STOP_WORDS


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_punctuation_collapse(spark):
    assert one(spark, text.collapse_punctuation, "a--b, c.d!?e\tf'g:h  i") == "a b c d e\tf'g:h i"


def test_clean_digits_and_non_word(spark):
    assert one(spark, lambda c: text.remove_non_word(text.remove_digits(c)), "café don't 12ab_c") == "caf dont ab_c"


def test_combine_skips_nulls(spark):
    df = spark.createDataFrame([(None, None), ("x", None), ("A", "B")], "a string, b string")
    got = [r.y for r in df.select(text.combine_text("a", "b").alias("y")).collect()]
    assert got == ["", "x", "a b"]


def test_epoch_to_date_utc(spark):
    df = spark.createDataFrame([(1388534400,)], "t long")
    r = df.select(dates.epoch_to_date("t").alias("d")).select(
        "d", *[v.alias(k) for k, v in dates.date_parts("d").items()]).first()
    assert str(r.d) == "2014-01-01" and r.day_of_week == 4 and r.year == 2014 and r.age == 9


def test_subjectivity_float_edges(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "s float")
    got = [r.b for r in df.select(bins.subjectivity_bin("s").alias("b")).collect()]
    assert got == ["2", "3", "4", "5"]


def test_null_score_bin_unknown(spark):
    assert one(spark, bins.compound_bin, None, "double") == "Unknown"


def test_compound_bin_edges(spark):
    vals = [-1.0, -0.75, -0.7, -0.5, -0.3, 0.0, 0.1, 0.25, 0.3, 0.5, 0.6, 0.75, 0.9]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.b for r in df.select(bins.compound_bin("x").alias("b")).collect()]
    assert got == ["1", "1", "2", "2", "3", "4", "5", "5", "6", "6", "7", "7", "8"]


def test_length_segments(spark):
    vals = [0, 499, 500, 1999, 2000, 19999, 20000, 33047, None]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    got = [(r.n, r.l) for r in df.select(bins.segment_number("x").alias("n"),
                                         bins.segment_label("x").alias("l")).collect()]
    assert [g[0] for g in got] == [1, 1, 2, 2, 3, 11, 12, 12, 13]
    assert got[-1][1] == "13.Other" and got[0][1] == "1.<500" and got[6][1] == "12.20k+"


def test_extremity_prediction(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (-0.6,), (-0.5,), (None,)], "x double")
    got = [r.p for r in df.select(bins.extremity_prediction("x").alias("p")).collect()]
    assert got == [0, 1, 1, 0, 0]


def test_bigrams(spark):
    from pyspark.ml.feature import NGram
    df = spark.createDataFrame([(["a"],), (["a", "b", "c"],), ([],)], "t array<string>")
    got = [r.g for r in df.select(text.ngrams("t", 2).alias("g")).collect()]
    assert got == [[], ["a b", "b c"], []]
    ml = [r.g for r in NGram(n=2, inputCol="t", outputCol="g").transform(df).collect()]
    assert ml == got


def test_stop_words_equal_spark_default():
    from pyspark.ml.feature import StopWordsRemover
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenize_matches_regex_tokenizer(spark):
    from pyspark.ml.feature import RegexTokenizer
    texts = [("Héllo, World! it's 2x_y",), ("  leading gap",), ("",), ("ÀB--cd",)]
    df = spark.createDataFrame(texts, "t string")
    sql = [r.w for r in df.select(text.tokenize("t").alias("w")).collect()]
    ml = [r.w for r in RegexTokenizer(inputCol="t", outputCol="w", pattern="\\W").transform(df).collect()]
    assert sql == ml


def test_stop_words_sql_form_matches_remover(spark):
    from pyspark.ml.feature import StopWordsRemover
    df = spark.createDataFrame([(["The", "cat", "is", "not", "don't", "dont"],)], "t array<string>")
    sql = df.select(text.remove_stop_words("t").alias("f")).first().f
    ml = StopWordsRemover(inputCol="t", outputCol="f").transform(df).first().f
    assert sql == ml == ["cat", "dont"]


def test_vector_element(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from reviewlens.functions.vectors import vector_element
    df = spark.createDataFrame([(Vectors.dense([0.25, 0.75]),)], T.StructType([T.StructField("v", VectorUDT())]))
    assert abs(df.select(vector_element("v", 1).alias("p")).first().p - 0.75) < 1e-7



def test_checkpoint_dir_is_kept_when_set(spark):
    from reviewlens.session import checkpoint_dir
    first = checkpoint_dir(spark)
    assert first and checkpoint_dir(spark) == first
