"""ML stages of the model notebook (N1-N10): tokenizer, stop words, Word2Vec,
assembler, min-max scaler, and the bigram / TF-IDF branch.

``Word2Vec`` (``operators.word2vec``) trains on as many partitions as the session shuffles to, but at
most ``WAVES`` for each core: every partition sends a vector for each of its words, and holds those. No vocabulary
or vector is held by the driver. Sentences longer than 1,000 words are split into chunks, all words are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    MinMaxScaler,
    NGram,
    RegexTokenizer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.sql import SparkSession

from reviewlens.functions.constants import (
    FEATURE_COLUMNS,
    IDF_MIN_DOC_FREQ,
    TF_MAX_DF,
    TF_MIN_DF,
    TF_VOCAB_SIZE,
    TOKEN_GAP_PATTERN,
    WORD2VEC_MIN_COUNT,
    WORD2VEC_SIZE,
)
from reviewlens.operators.word2vec import Word2Vec


WAVES = 1


def tokenizer(input_col: str = "combined_text", output_col: str = "words") -> RegexTokenizer:
    """N1."""
    return RegexTokenizer(inputCol=input_col, outputCol=output_col, pattern=TOKEN_GAP_PATTERN)


def stop_words(input_col: str = "words", output_col: str = "filtered") -> StopWordsRemover:
    """N2 / N14 (case-insensitive default English list)."""
    return StopWordsRemover(inputCol=input_col, outputCol=output_col)


def word2vec(input_col: str = "filtered", output_col: str = "word2vec_features", seed: int = 47,
             num_partitions: int | None = None, vector_size: int = WORD2VEC_SIZE,
             min_count: int = WORD2VEC_MIN_COUNT) -> Word2Vec:
    """Document vector = mean of word vectors."""
    if not num_partitions:
        spark = SparkSession.active()
        num_partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)
    return Word2Vec(vectorSize=vector_size, minCount=min_count, inputCol=input_col, outputCol=output_col,
                    seed=seed, numPartitions=num_partitions)


def assembler(input_cols: Sequence[str] = FEATURE_COLUMNS, output_col: str = "features_assembled") -> VectorAssembler:
    """A null input is an error (the feature build leaves none)."""
    return VectorAssembler(inputCols=list(input_cols), outputCol=output_col, handleInvalid="error")


def scaler(input_col: str = "features_assembled", output_col: str = "features") -> MinMaxScaler:
    """Constant features map to 0.5."""
    return MinMaxScaler(inputCol=input_col, outputCol=output_col)


def text_feature_pipeline(seed: int = 47, num_partitions: int | None = None) -> Pipeline:
    """Model notebook's text + assembly pipeline, with the assembler put back
    in front of the scaler (the notebook left it commented out)."""
    return Pipeline(stages=[tokenizer(), stop_words(), word2vec(seed=seed, num_partitions=num_partitions),
                            assembler(), scaler()])


def bigram_count_stages(input_col: str = "filtered", vocab_size: int = TF_VOCAB_SIZE,
                        min_df: float = TF_MIN_DF, max_df: float = TF_MAX_DF) -> list:
    """N4 + N5: bigrams and their term-frequency vector."""
    return [NGram(n=2, inputCol=input_col, outputCol="ngrams"),
            CountVectorizer(inputCol="ngrams", outputCol="rawFeatures_n", vocabSize=vocab_size,
                            minTF=1, minDF=min_df, maxDF=max_df)]


def tfidf_stages(input_col: str = "filtered", vocab_size: int = TF_VOCAB_SIZE, min_df: float = TF_MIN_DF,
                 max_df: float = TF_MAX_DF, min_doc_freq: int = IDF_MIN_DOC_FREQ) -> list:
    """N5 + N6 + N7 on unigrams (dormant branch of the notebook)."""
    return [CountVectorizer(inputCol=input_col, outputCol="rawFeatures", vocabSize=vocab_size, minTF=1,
                            minDF=min_df, maxDF=max_df),
            IDF(inputCol="rawFeatures", outputCol="idfFeatures", minDocFreq=min_doc_freq),
            MinMaxScaler(inputCol="idfFeatures", outputCol="scaled_idfFeatures")]

