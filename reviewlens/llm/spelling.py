"""Spelling variants: words one edit apart, joined by asymmetric q-chunks.

Words of ``n`` code points give two disjoint chunks, their first and last ``n // 2``;
the other word of a pair gives positional grams. One inserted, deleted or replaced
code point leaves one chunk whole, and it stands in the other word at the same place
or, behind an insertion or deletion, one place earlier. So of the other word's grams
only those within shift one of a chunk's place can meet it, and only they are sent.
The longer word of a pair gives the chunks (equal lengths: both words give both).

Frequent halves (endings, prefixes) join large groups, so the lemma is applied once
more: what lies beside the whole chunk holds the edit and keeps one of its own two
chunks. Keys hash both levels, chunk and chunk of the rest, about three quarters of a
word; candidates are verified inside the join and never leave it.

Texts may be null (no words) or of any length; nothing is cut. A null id counts as
empty text in the hash. Repeated rows count again. No words: an empty result. Other
columns are ignored. Ties: the smallest word in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import ascii_lower, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DELETE_EVERY = 7, 2, 10, 31


def words(docs: DataFrame) -> DataFrame:
    """``word, n``: lower-cased runs of letters of all texts, one code point taken out of some
    by a hash of id and run; at least ``LEAST_LENGTH`` long and met ``LEAST_COUNT`` times."""
    # a deletion only shortens: shorter runs cannot become words
    runs = F.regexp_extract_all("text", F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), F.lit(1))
    met = docs.select("doc_id", F.explode_outer(runs).alias("run")).filter(F.col("run").isNotNull())
    met = met.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    met = met.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run"))
    return (met.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT))


def _chunks(word: Column, length: Column, size: Column) -> list[tuple[Column, Column]]:
    """The first and last ``size`` code points of a word, each with what lies beside it."""
    return [(F.substr(word, F.lit(1), size), F.substr(word, size + 1)),
            (F.substr(word, length - size + 1, size), F.substr(word, F.lit(1), length - size))]


def chunk_keys(word: Column, shorter: int) -> Column:
    """Keys of a word in pairs whose longer word has ``shorter`` (0 or 1) more code points.

    For 0 these are the chunks, which are also the grams for a word of equal length; for 1 the
    grams where that longer word's chunks stand when the code point it has more lies elsewhere.
    """
    length = F.char_length(word)
    longer = length + shorter
    size = F.floor(longer / 2).cast("int")
    keys = []
    for first, (chunk, rest) in enumerate(_chunks(word, length, size)):
        rest_size = F.floor((longer - size) / 2).cast("int")
        for second, (part, _) in enumerate(_chunks(rest, length - size, rest_size)):
            keys.append(F.xxhash64(longer, F.lit(2 * first + second), chunk, part))
    return F.array(*keys)


def near_pairs(found: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words one edit apart, once."""
    as_longer = found.select(F.col("word").alias("a"), F.col("n").alias("n_a"),
                             F.explode(chunk_keys(F.col("word"), 0)).alias("key"))
    as_other = found.select(F.col("word").alias("b"), F.col("n").alias("n_b"),
                            F.explode(F.concat(chunk_keys(F.col("word"), 0), chunk_keys(F.col("word"), 1))).alias("key"))
    once = (F.char_length("a") > F.char_length("b")) | (F.col("a") < F.col("b"))  # of equal lengths, one order
    near = (as_longer.key == as_other.key) & once & (F.levenshtein("a", "b", 1) == 1)
    return as_longer.hint("merge").join(as_other, near).select("a", "n_a", "b", "n_b").distinct()


def forms(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near word of largest count, if ``FORM_RATIO`` times as frequent."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("rank"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("rank"), F.col("a").alias("other")))).alias("p"))
    near = both.groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"),
                                      F.min(F.struct("p.rank", "p.other")).alias("best"))
    taken = -F.col("best.rank") >= FORM_RATIO * F.col("n")
    return found.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form. Counts rise ``FORM_RATIO`` times a step, so
    chains are short (18 steps for any long), and each round doubles the steps taken."""
    spark = linked.sparkSession
    now = stored(spark, linked.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(spark, now.join(ahead, "root", "left")
                       .select("word", F.coalesce("further", "root").alias("root"),
                               F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    found = stored(spark, words(docs), "words")
    linked = stored(spark, forms(found, near_pairs(found)), "near-words")
    return (linked.join(roots(linked), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
