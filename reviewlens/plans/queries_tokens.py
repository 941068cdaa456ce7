"""Registered queries: model-notebook text stages (T3-T6, N1, N2, N4-N6, N8,
N11-N14)."""

from __future__ import annotations

from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.functions import text
from reviewlens.functions.constants import TOKEN_GAP_PATTERN
from reviewlens.operators import tokens
from reviewlens.plans import sqlforms as S
from reviewlens.plans.catalog import register
from reviewlens.sources import reviews_from_documents, reviews_from_lineitems, texts_from_documents

TXT = S.with_ctes(S.REVIEWS, S.text_rows())


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reviewID, combined_text_length, combined_text, words, filtered) with the
    model notebook's own ML stages (N1, N2), straight from the document scan."""
    r = texts_from_documents(spark, sf_dir)
    raw = text.combine_text("reviewText", "summary")
    rows = r.select("reviewID", text.text_length(raw).alias("combined_text_length"),
                    text.clean_text(raw).alias("combined_text"))
    rows = RegexTokenizer(inputCol="combined_text", outputCol="words", pattern=TOKEN_GAP_PATTERN).transform(rows)
    return StopWordsRemover(inputCol="words", outputCol="filtered").transform(rows)


@register("t3_t6_clean_text", TXT + """
select c.reviewID, c.combined_text_length, c.combined_text, length(c.combined_text) as clean_length
from lg_clean c""")
def t3_t6_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined lower-case text, length before cleaning, punctuation
    collapse, digits and non-word characters removed (whole texts)."""
    rows = text_rows(spark, sf_dir)
    return rows.select("reviewID", "combined_text_length", "combined_text",
                       text.text_length("combined_text").alias("clean_length"))


@register("n1_regex_tokens", TXT + """
select reviewID, len(words) as n_words, array_to_string(words, ' ') as words from lg_tok""")
def n1_regex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``RegexTokenizer(pattern='\\W')`` tokens of the cleaned text."""
    rows = text_rows(spark, sf_dir)
    return rows.select("reviewID", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


@register("n2_n14_stop_words_removed", TXT + """
select reviewID, len(filtered) as n_filtered, array_to_string(filtered, ' ') as filtered from lg_filt""")
def n2_n14_stop_words_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default English ``StopWordsRemover`` (case-insensitive)."""
    rows = text_rows(spark, sf_dir)
    return rows.select("reviewID", F.size("filtered").alias("n_filtered"),
                       F.array_join("filtered", " ").alias("filtered"))


@register("n4_bigrams", TXT + """
, bg as (select reviewID, list_transform(range(1, len(filtered)), lambda i: filtered[i] || ' ' || filtered[i + 1]) as ngrams
         from lg_filt)
select reviewID, len(ngrams) as n_bigrams, array_to_string(ngrams, '|') as bigrams from bg""".replace("\n, bg", ",\nbg"))
def n4_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``NGram(n=2)`` over the stop-word-filtered tokens."""
    rows = _bigrams(text_rows(spark, sf_dir))
    return rows.select("reviewID", F.size("ngrams").alias("n_bigrams"), F.array_join("ngrams", "|").alias("bigrams"))


VOCAB_SQL = TXT + """
, freq as (select term, count(distinct reviewID) as doc_freq, count(*) as term_freq
           from (select reviewID, unnest(filtered) as term from lg_filt) group by term),
ndocs as (select count(*) as n from lg_filt),
vocab as (select term, doc_freq, term_freq from freq, ndocs
          where doc_freq >= 50 and doc_freq <= 0.4 * n order by term_freq desc, term limit 10000)
""".replace("\n, freq", ",\nfreq")


@register("n5_term_frequency_vocabulary", VOCAB_SQL + "select term, doc_freq, term_freq from vocab")
def n5_term_frequency_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary with document-frequency bounds (minDF 50, maxDF 0.40,
    10,000 terms) and term frequencies."""
    return tokens.vocabulary(text_rows(spark, sf_dir), "reviewID", "filtered")


@register("n6_inverse_document_frequency", VOCAB_SQL + """
select term, doc_freq, case when doc_freq >= 5 then ln((n + 1.0) / (doc_freq + 1.0)) else 0.0 end as idf
from vocab, ndocs""")
def n6_inverse_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF weight per vocabulary term (minDocFreq 5)."""
    rows = text_rows(spark, sf_dir)
    vocab = tokens.vocabulary(rows, "reviewID", "filtered")
    n_docs = rows.select(F.count(F.lit(1))).scalar()
    return tokens.inverse_document_frequency(vocab, n_docs)


BIGRAM_SQL = TXT + """,
bg as (select reviewID, list_transform(range(1, len(filtered)), lambda i: filtered[i] || ' ' || filtered[i + 1]) as terms
       from lg_filt)"""


def _vocab_ctes(source: str, column: str) -> str:
    """Vocabulary, IDF and scaled TF-IDF of a token-array column."""
    return f""",
cell as (select reviewID, term, count(*) as tf from (select reviewID, unnest({column}) as term from {source}) group by all),
ndocs as (select count(*) as n from {source}),
vocab as (select term, count(*) as doc_freq, sum(tf) as term_freq from cell group by term),
kept as (select term, doc_freq, case when doc_freq >= 5 then ln((n + 1.0) / (doc_freq + 1.0)) else 0.0 end as idf
         from vocab, ndocs where doc_freq >= 50 and doc_freq <= 0.4 * n order by term_freq desc, term limit 10000),
w as (select reviewID, term, tf * idf as x from cell join kept using (term)),
rng as (select term, case when count(*) = (select n from ndocs) then min(x) else least(min(x), 0) end as lo, max(x) as hi
        from w group by term),
sc as (select reviewID, x, case when hi > lo then (x - lo) / (hi - lo) else 0.5 end as s from w join rng using (term))
"""


SCALED_SQL = """select reviewID, count(*) as n_terms, sum(x) as sum_tf_idf, max(s) as max_scaled from sc group by reviewID"""


def _bigrams(rows: DataFrame) -> DataFrame:
    return NGram(n=2, inputCol="filtered", outputCol="ngrams").transform(rows)


def _idf(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    vocab = tokens.vocabulary(rows, "reviewID", column).checkpoint(eager=True)  # at most 10,000 terms
    return vocab, tokens.inverse_document_frequency(vocab, rows.select(F.count(F.lit(1))).scalar())


def _scaled(rows: DataFrame, column: str) -> DataFrame:
    vocab, idf = _idf(rows, column)
    cells = tokens.tf_idf_scaled(rows, vocab, idf, "reviewID", column)
    return cells.groupBy("reviewID").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf_idf").alias("sum_tf_idf"),
                                         F.max("scaled").alias("max_scaled"))


@register("n6_bigram_document_frequency", BIGRAM_SQL + _vocab_ctes("bg", "terms") + "select term, doc_freq, idf from kept")
def n6_bigram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4 + N5 + N6: bigram vocabulary with document frequencies and IDF."""
    return _idf(_bigrams(text_rows(spark, sf_dir)), "ngrams")[1]


@register("n7_scaled_tf_idf", TXT + _vocab_ctes("lg_filt", "filtered") + SCALED_SQL)
def n7_scaled_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5 + N6 + N7 on sparse cells: TF-IDF and its min-max scaling per review."""
    return _scaled(text_rows(spark, sf_dir), "filtered")


@register("n7_scaled_bigram_tf_idf", BIGRAM_SQL + _vocab_ctes("bg", "terms") + SCALED_SQL)
def n7_scaled_bigram_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4-N7 on bigrams: TF-IDF and its min-max scaling per review."""
    return _scaled(_bigrams(text_rows(spark, sf_dir)), "ngrams")


@register("n8_string_index_reviewers", S.with_ctes(S.REVIEWS) + """
select reviewerID, row_number() over (order by count(*) desc, reviewerID) - 1 as index
from reviews where reviewerID is not null group by reviewerID""")
def n8_string_index_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer index, most frequent first, ties alphabetical."""
    r = reviews_from_documents(spark, sf_dir, lambda d: d.drop("reviewText", "summary"), label=False)
    return tokens.frequency_index(r, "reviewerID")


@register("n8_string_index_products", S.with_ctes(S.LINE_REVIEWS) + """
select asin as productId, row_number() over (order by count(*) desc, asin) - 1 as index
from line_reviews where asin is not null group by asin""")
def n8_string_index_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product index at volume."""
    r = reviews_from_lineitems(spark, sf_dir).withColumnRenamed("asin", "productId")
    return tokens.frequency_index(r, "productId")


@register("n11_normalized_tokens", TXT + """
, nt as (select reviewID, list_filter(list_transform(words, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')),
                                     lambda x: x <> '') as normalized from lg_tok)
select reviewID, len(normalized) as n_normalized, array_to_string(normalized, ' ') as normalized from nt""".replace("\n, nt", ",\nnt"))
def n11_normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token normaliser (letters only, lower case, empties dropped)."""
    rows = text_rows(spark, sf_dir).select("reviewID", text.normalize_tokens("words").alias("normalized"))
    return rows.select("reviewID", F.size("normalized").alias("n_normalized"),
                       F.array_join("normalized", " ").alias("normalized"))


def fixture_lemmas(rows: DataFrame) -> DataFrame:
    """Lemma dictionary by rule over the corpus's own filtered tokens: a form
    of 5+ letters ending in a single 's' maps to the form without it."""
    forms = text.explode_tokens(rows, [], "filtered", "form").distinct()
    forms = forms.where((F.length("form") >= 5) & F.col("form").endswith("s") & ~F.col("form").endswith("ss"))
    return forms.select("form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))


@register("n12_lemmatized_tokens", TXT + """
, lemmas as (select distinct form, substring(form, 1, length(form) - 1) as lemma
             from (select unnest(filtered) as form from lg_filt)
             where length(form) >= 5 and form like '%s' and form not like '%ss'),
pos as (select reviewID, filtered[i] as tok, i from (select reviewID, filtered, unnest(range(1, len(filtered) + 1)) as i from lg_filt)),
lem as (select p.reviewID, string_agg(coalesce(l.lemma, p.tok), ' ' order by p.i) as lemmas, count(*) as n
        from pos p left join lemmas l on p.tok = l.form group by p.reviewID)
select f.reviewID, coalesce(lem.n, 0) as n_lemmas, coalesce(lem.lemmas, '') as lemmas
from lg_filt f left join lem on f.reviewID = lem.reviewID""".replace("\n, lemmas", ",\nlemmas"))
def n12_lemmatized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12 re-aimed: tokens replaced by their lemma through a join to a
    (form, lemma) table, order kept."""
    rows = text_rows(spark, sf_dir)
    out = tokens.lemmatize(rows, fixture_lemmas(rows), "reviewID", "filtered")
    return out.select("reviewID", F.size("lemmas").cast("bigint").alias("n_lemmas"),
                      F.array_join("lemmas", " ").alias("lemmas"))


@register("n13_marked_unknown_words", TXT + f"""
, words as (select distinct unnest({S.tokens_of('text')}) as word from benchmark),
sp as (select reviewID, list_filter(string_split_regex(coalesce(combined_text, ''), '\\s+'), lambda x: x <> '') as arr from lg_clean),
pos as (select reviewID, arr[i] as tok, i from (select reviewID, arr, unnest(range(1, len(arr) + 1)) as i from sp)),
mk as (select p.reviewID, string_agg(case when w.word is not null then p.tok else '[' || p.tok || ']' end, ' ' order by p.i) as marked
       from pos p left join words w on lower(p.tok) = w.word group by p.reviewID)
select c.reviewID, coalesce(mk.marked, '') as marked_text
from lg_clean c left join mk on c.reviewID = mk.reviewID""".replace("\n, words", ",\nwords"))
def n13_marked_unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N13 re-aimed: words missing from a dictionary table (the benchmark
    corpus's vocabulary) wrapped in brackets, whole texts."""
    rows = text_rows(spark, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    words = text.explode_tokens(bench, [], text.tokenize("text"), "word").distinct()
    return tokens.mark_unknown(rows, words, "reviewID", "combined_text")
