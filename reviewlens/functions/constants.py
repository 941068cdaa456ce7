"""Fixed values.

The first sections are values the analysed notebooks use (patterns, segment
bounds and labels, bin edges, thresholds, model settings); results change if
they differ. The sentiment sections are the published constants of the VADER
method and this package's default modifier word lists. All are stated here
plainly and in their natural order.
"""

# ---- fixed values: analysis conventions ------------------------------------
# Year the review age is measured from ("2023 - year").
AS_OF_YEAR = 2023

# Punctuation collapsed to one space (hyphen, question mark, space,
# exclamation mark, comma, full stop); quotes, colons, tabs and newlines stay.
PUNCT_COLLAPSE_PATTERN = "[-? ! , .]+"
# Digits removed.
DIGITS_PATTERN = r"\d+"
# Characters that are neither word characters nor white space, removed.
NON_WORD_PATTERN = r"[^\w\s]"
# Token separator of the regex tokenizer (gaps = non-word characters).
TOKEN_GAP_PATTERN = r"\W"

# ---- fixed values: length segments -----------------------------------------
# Upper bounds (exclusive) of segments 1..11; segment 12 is 20k and more,
# segment 13 catches anything else (a null length).
LENGTH_SEGMENT_BOUNDS = [500, 2000, 4000, 6000, 8000, 10000, 12000, 14000, 16000, 18000, 20000]
LENGTH_SEGMENT_LABELS = [
    "1.<500", "2.500 to 2k", "3.2k to 4k", "4.4k to 6k", "5.6k to 8k", "6.8k to 10K",
    "7.10K to 12k", "8.12K to 14k", "9.14K to 16k", "10.16K to 18k", "11.18K to 20k",
    "12.20k+", "13.Other",
]

# ---- fixed values: score bins (right-closed upper edges) --------------------
COMPOUND_BIN_EDGES = [-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75]
POLARITY_BIN_EDGES = [0.0, 0.25, 0.5, 0.75]
SUBJECTIVITY_BIN_EDGES = [0.2, 0.4, 0.6, 0.8]
UNKNOWN_BIN = "Unknown"
# Rule classifier: |compound| above this is predicted helpful.
EXTREMITY_THRESHOLD = 0.5

# ---- fixed values: histogram ----------------------------------------------
HISTOGRAM_BINS = 50

# ---- fixed values: compound sentiment normalisation -------------------------
# Published constants of the VADER method (Hutto & Gilbert, ICWSM 2014):
# normalisation alpha, negation scalar, booster increment.
COMPOUND_ALPHA = 15.0
NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293
# Polarity of a negated word is multiplied by this (pattern-based polarity).
POLARITY_NEGATION = -0.5
# How many preceding tokens are searched for a negation word.
NEGATION_WINDOW = 3

# Emphasis (same method): each exclamation mark up to four; two or three question
# marks count each, more count as a whole.
EXCLAMATION_INCREMENT = 0.292
MAX_EXCLAMATIONS = 4
QUESTION_INCREMENT = 0.18
MAX_QUESTIONS = 3
MANY_QUESTIONS = 0.96
# Contrast (same method): words in front of the first "but" count half, those behind it one and a half times.
CONTRAST_WORD = "but"
BEFORE_CONTRAST = 0.5
AFTER_CONTRAST = 1.5

# ---- fixed values: default modifier words (this package's defaults) --------
NEGATION_WORDS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere",
    "cannot", "without", "isnt", "dont", "doesnt", "didnt", "wasnt", "wont", "cant",
]
BOOSTER_WORDS = [
    "absolutely", "completely", "extremely", "highly", "incredibly", "most", "really",
    "so", "totally", "very",
]
DAMPENER_WORDS = ["barely", "hardly", "less", "little", "slightly", "somewhat"]

# ---- fixed values: model defaults of the main boosted-tree model ------------
MAIN_MODEL = {
    "step_size": 0.05,
    "max_iter": 2000,
    "num_leaves": 50,
    "lambda_l1": 1.0,
    "lambda_l2": 1.0,
    "feature_fraction": 0.85,
}
# The other models' settings, where they differ from the library defaults.
BIGRAM_MODEL = {"max_iter": 10, "vocab_size": 10000, "min_df": 50, "max_df": 0.40}
LOGISTIC_MODEL = {"maxIter": 20, "regParam": 0.1, "elasticNetParam": 0.0}
PERCEPTRON_MODEL = {"hidden": [2], "classes": 2, "maxIter": 10, "blockSize": 128}
LOGISTIC_GRID = {"maxIter": [10, 20, 30], "regParam": [0.1, 0.01, 0.001], "elasticNetParam": [0.0, 0.1, 0.2]}
GRID_FOLDS = 3

SPLIT_SEED = 47
SPLIT_WEIGHTS = [0.8, 0.2]

# Declared scalar feature order of the main model, then the text embedding.
FEATURE_COLUMNS = [
    "verified", "overall", "year", "month", "day_of_week", "age", "reviews_per_product",
    "reviewers_per_product", "product_review_interval", "polarity_score", "sentiment_score",
    "combined_text_length", "word2vec_features",
]
WORD2VEC_SIZE = 100
WORD2VEC_MIN_COUNT = 5

# ---- fixed values: term-frequency bounds -----------------------------------
TF_VOCAB_SIZE = 10000
TF_MIN_DF = 50
TF_MAX_DF = 0.40
IDF_MIN_DOC_FREQ = 5
