"""Lexicon sentiment as a relational job (no per-row Python library).

Method (own, documented semantics):

* Tokens: lower-cased text without apostrophes (``don't`` -> ``dont``), split on
  non-word characters (ASCII ``\\W``).
* Context: for each token, whether a negation word occurs among the
  ``NEGATION_WINDOW`` preceding tokens and whether the previous token is a
  booster / dampener. Context is taken from the token array itself
  (by index, next to the exploded token), so no window or self-join is needed.
* Modifiers: a ``modifiers`` table (token, kind, weight): kind ``negate``, or
  ``boost`` with the increment (negative for dampeners).
* Join: tokens are exploded and inner-joined to the ``lexicon`` table
  (token, valence, polarity, subjectivity), so occurrences without a match
  vanish there; scores are joined back by id. A lexicon table is normally small
  and AQE broadcasts it from its measured size; a large one falls back to a
  shuffle join with AQE skew splitting.
* Compound (Z1): valence +/- booster increment, times the negation scalar when
  negated, times the contrast weight (half in front of the review's first "but", one and a half
  behind it), summed per review to ``s``; exclamation marks (at most four) and two or more
  question marks strengthen ``s`` in its own direction; compound = s / sqrt(s^2 + alpha)
  (Hutto & Gilbert 2014).
* Polarity (Z2): mean matched polarity, a negated word's polarity times
  ``POLARITY_NEGATION``; 0.0 when nothing matches.
* Subjectivity (Z3): mean matched subjectivity; 0.0 when nothing matches.

Per-token contributions are summed as integers in units of 1e-8, so the scores
do not depend on the order rows reach the aggregate (identical across
partitionings and reruns) and the sums stay in fast fixed-width arithmetic.
Scores are returned as ``float`` like the analysed notebooks' UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlens.functions.constants import (
    AFTER_CONTRAST,
    BEFORE_CONTRAST,
    BOOSTER_INCREMENT,
    BOOSTER_WORDS,
    COMPOUND_ALPHA,
    CONTRAST_WORD,
    DAMPENER_WORDS,
    EXCLAMATION_INCREMENT,
    MANY_QUESTIONS,
    MAX_EXCLAMATIONS,
    MAX_QUESTIONS,
    NEGATION_SCALAR,
    NEGATION_WINDOW,
    NEGATION_WORDS,
    POLARITY_NEGATION,
    QUESTION_INCREMENT,
)
from reviewlens.functions.text import explode_tokens, tokenize
from reviewlens.schema import MODIFIERS

# Per-token contributions are summed as integers in units of 1e-8 (exact and
# independent of summation order), then scaled back.
_SCALE = 100_000_000.0


# A modifiers table is used as literal word lists, so its size is bounded.
MAX_MODIFIERS = 10_000


def _default_rows() -> list[tuple[str, str, float]]:
    return ([(w, "negate", 0.0) for w in NEGATION_WORDS] + [(w, "boost", BOOSTER_INCREMENT) for w in BOOSTER_WORDS]
            + [(w, "boost", -BOOSTER_INCREMENT) for w in DAMPENER_WORDS])


def default_modifiers(spark: SparkSession) -> DataFrame:
    """This package's modifier words as a table (token, kind, weight)."""
    return spark.createDataFrame(_default_rows(), MODIFIERS)


def _modifier_words(modifiers: DataFrame | None) -> tuple[list[str], dict[float, list[str]]]:
    """Negation words, and booster words by weight (a word listed twice takes its largest
    weight). Without a table the default lists are used as they are, with no Spark job."""
    if modifiers is None:
        return sorted(NEGATION_WORDS), {BOOSTER_INCREMENT: sorted(BOOSTER_WORDS), -BOOSTER_INCREMENT: sorted(DAMPENER_WORDS)}
    rows = modifiers.select("token", "kind", "weight").distinct().limit(MAX_MODIFIERS + 1).collect()
    if len(rows) > MAX_MODIFIERS:
        raise ValueError(f"more than {MAX_MODIFIERS} modifier words")
    weights = {}
    for r in rows:
        if r.kind == "boost" and r.token is not None:
            weights[r.token] = max(r.weight, weights.get(r.token, r.weight))
    by_weight: dict[float, list[str]] = {}
    for word, weight in sorted(weights.items()):
        by_weight.setdefault(float(weight), []).append(word)
    return sorted({r.token for r in rows if r.kind == "negate" and r.token is not None}), by_weight


def _in_list(x: Column, words: Sequence[str]) -> Column:
    # ``isin`` becomes a hash-set lookup (InSet) for longer lists.
    return F.coalesce(x.isin(list(words)), F.lit(False)) if words else F.lit(False)


def booster(t: Column, boosters: dict[float, list[str]]) -> Column:
    """Increment (+/-/0) of a booster or dampener word."""
    out = F.lit(0.0)
    for weight, words in sorted(boosters.items()):
        out = F.when(_in_list(t, words), F.lit(weight)).otherwise(out)
    return out


def sentiment_tokens(text: str | Column) -> Column:
    """Z0 tokens: apostrophes (straight and curly) dropped, then N1."""
    c = F.col(text) if isinstance(text, str) else text
    return tokenize(F.translate(c, "'\u2019", ""))


def emphasis(text: str | Column) -> Column:
    """What exclamation and question marks add to the strength of a review."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def marks(sign: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    questions = F.when(marks("?") <= 1, F.lit(0.0)).when(marks("?") <= MAX_QUESTIONS, marks("?") * QUESTION_INCREMENT).otherwise(
        F.lit(MANY_QUESTIONS))
    return F.least(marks("!"), F.lit(MAX_EXCLAMATIONS)) * F.lit(EXCLAMATION_INCREMENT) + questions


def contrast_weight(position: Column, contrast: Column) -> Column:
    """Weight of the word at ``position`` (from 0) when the contrast word stands at ``contrast`` (from 1, 0: nowhere)."""
    return (F.when((contrast == 0) | (position + 1 == contrast), F.lit(1.0))
            .when(position + 1 < contrast, F.lit(BEFORE_CONTRAST)).otherwise(F.lit(AFTER_CONTRAST)))


def lexicon_tokens(df: DataFrame, id_col: str, text_col: str, modifiers: DataFrame | None = None,
                   window: int = NEGATION_WINDOW) -> DataFrame:
    """One row per token occurrence with its context (id, pos, tok, negated, boost, contrast, emphasis)."""
    # Each token's row reads its neighbours from the array by index (out of range gives null): plain columns over
    # the explode, compiled with it, where lambdas over the array would be interpreted for every token.
    negations, boosters = _modifier_words(modifiers)
    with_tokens = df.select(id_col, sentiment_tokens(text_col).alias("_toks"), emphasis(text_col).alias("emphasis"))
    with_tokens = with_tokens.withColumn("_but", F.array_position("_toks", F.lit(CONTRAST_WORD)))
    exploded = with_tokens.select("*", F.posexplode_outer("_toks").alias("pos", "tok")).where(F.col("tok").isNotNull())
    before = lambda k: F.get("_toks", F.col("pos") - k)
    negated = F.lit(False)
    for k in range(1, window + 1):
        negated = negated | _in_list(before(k), negations)
    return exploded.select(id_col, "pos", "tok", negated.alias("negated"), booster(before(1), boosters).alias("boost"),
                           contrast_weight(F.col("pos"), F.col("_but")).alias("contrast"), "emphasis")


SCORES = ("compound_score", "polarity_score", "sentiment_score")


def _score_columns(id_col: str) -> list[Column]:
    s = (F.col("_s") + F.signum(F.col("_s")) * F.col("_emphasis")).cast("double") / F.lit(_SCALE)
    compound = s / F.sqrt(s * s + F.lit(COMPOUND_ALPHA))
    ps = F.col("_ps").cast("double") / F.lit(_SCALE)
    ss = F.col("_ss").cast("double") / F.lit(_SCALE)
    polarity = F.coalesce(F.try_divide(ps, F.col("_pn").cast("double")), F.lit(0.0))
    subjectivity = F.coalesce(F.try_divide(ss, F.col("_sn").cast("double")), F.lit(0.0))
    return [F.col(id_col), *[c.cast("float").alias(n) for c, n in zip((compound, polarity, subjectivity), SCORES)]]


def _units(x: Column) -> Column:
    return F.rint(x * F.lit(_SCALE)).cast("long")


def sentiment_scores(df: DataFrame, lexicon: DataFrame, id_col: str = "reviewID", text_col: str = "reviewTot",
                     modifiers: DataFrame | None = None) -> DataFrame:
    """Z1-Z3 per id with at least one lexicon word. A token listed twice in the
    lexicon would count twice, so its smallest entry is taken. ``id_col`` must be unique."""
    words = (lexicon.groupBy(F.col("token").alias("tok"))
             .agg(F.min(F.struct("valence", "polarity", "subjectivity")).alias("e")).select("tok", "e.*"))
    hits = lexicon_tokens(df, id_col, text_col, modifiers).join(words, on="tok", how="inner")
    v = F.col("valence")
    boosted = v + F.col("boost") * F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    compound_part = F.when(F.col("negated"), boosted * F.lit(NEGATION_SCALAR)).otherwise(boosted) * F.col("contrast")
    polarity_part = F.when(F.col("negated"), F.col("polarity") * F.lit(POLARITY_NEGATION)) \
        .otherwise(F.col("polarity"))
    agg = hits.groupBy(id_col).agg(
        F.coalesce(F.sum(_units(compound_part)), F.lit(0)).alias("_s"),
        F.max(_units(F.col("emphasis"))).alias("_emphasis"),
        F.sum(_units(polarity_part)).alias("_ps"),
        F.count(F.col("polarity")).alias("_pn"),
        F.sum(_units(F.col("subjectivity"))).alias("_ss"),
        F.count(F.col("subjectivity")).alias("_sn"),
    )
    return agg.select(*_score_columns(id_col))


def add_sentiment(df: DataFrame, scores: DataFrame, id_col: str = "reviewID") -> DataFrame:
    """Scores joined back to every row of ``df``; 0.0 when no lexicon word occurs."""
    out = df.join(scores, on=id_col, how="left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0).cast("float")) for c in SCORES})


def fixture_lexicon(df: DataFrame, text_col: str) -> DataFrame:
    """Lexicon by fixed arithmetic over the words of a small table (the fixture
    texts are invented words, so no real lexicon would match):
    valence = ascii(token) % 9 - 4, polarity = valence / 4,
    subjectivity = (length(token) % 11) / 10.
    """
    distinct = explode_tokens(df, [], sentiment_tokens(text_col), "token").distinct()
    valence = (F.ascii("token") % 9 - 4).cast("double")
    return distinct.select(
        "token",
        valence.alias("valence"),
        (valence / 4).alias("polarity"),
        ((F.length("token") % 11) / 10).cast("double").alias("subjectivity"),
    )
