"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is ``target rows * weight share / its rows``.
Each row's count inverts the Poisson distribution of that mean at a uniform
number hashed from seed and id; the row is repeated that often and all copies
are dealt to partitions and ordered by another hash, a global shuffle that any
retry repeats exactly. Means above ``STEP`` are the sum of several Poisson
numbers of at most that mean (their cumulative sums would underflow).

Only DataFrame functions are used. Sources that the weights do not name get
``default_weight``; null is a source like any other. Negative or missing weights
count as 0: such rows go. Without a positive weight, or for an empty table, the
result is empty. A row is named by its id, one without an id by the md5 of its text;
rows of one name get equal counts. Columns keep the names they have; ``mix`` adds
``replica`` and ``mix_key``, which replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import fields_of, stored, whole_row

STEP = 32.0
MAX_SOURCES = 100_000  # rates are broadcast only up to this many sources (a few MB)


def uniform(*parts: Column) -> Column:
    """A number of [0, 1) with 52 bits from the md5 of the joined parts."""
    text = F.concat_ws("/", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """Smallest k whose cumulative probability exceeds ``u``; ``mean`` at most ``STEP``."""
    last = (mean + 12.0 * F.sqrt(mean) + 20.0).cast("int")  # beyond it lies less than 2**-52
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    state = F.aggregate(
        F.sequence(F.lit(1), last), first,
        lambda s, k: F.when(s["c"] > u, s).otherwise(
            F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), k.alias("k"))))
    return state["k"]


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float, source: str = "source",
          target_rows: int | None = None) -> DataFrame:
    """``source, n, rate`` for each source found; one aggregate, partial sums before the shuffle."""
    counted = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default_weight))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col(source) == name, F.lit(float(value))).otherwise(weight)
    counted = counted.withColumn("weight", F.greatest(weight, F.lit(0.0)))
    counted = stored(docs.sparkSession, counted, "source-counts")
    all_weight, all_rows = counted.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    target = all_rows if target_rows is None else target_rows
    rate = F.lit(float(target)) * F.col("weight") / F.lit(all_weight) / F.col("n") if all_weight > 0 else F.lit(0.0)
    return counted.select(source, "n", rate.alias("rate"))


def row_name(doc_id: Column, text: Column) -> Column:
    """What the hashes of a row start from: its id or, without one, its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def replicated(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: int = 42,
               target_rows: int | None = None) -> DataFrame:
    """``record`` (a row of ``docs``), ``name`` and ``replica`` 0, 1, ... by its Poisson count; not yet shuffled."""
    rate = rates(docs, weights, default_weight, target_rows=target_rows)
    # one row a source: broadcast if that is provably small, else a join that splits hot sources
    few = rate.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    rate = rate.select(F.col("source").alias("rate_source"), "rate")
    rows = docs.select(whole_row(docs), row_name(F.col("doc_id"), F.col("text")).alias("name"))
    out = rows.join(F.broadcast(rate) if few else rate, F.col("record.source").eqNullSafe(F.col("rate_source")))
    steps = F.greatest(F.ceil(F.col("rate") / STEP).cast("int"), F.lit(1))
    one = lambda j: poisson(uniform(F.lit(str(seed)), F.col("name"), j.cast("string")), F.col("rate") / steps)
    count = F.aggregate(F.transform(F.sequence(F.lit(1), steps), one), F.lit(0), lambda a, b: a + b)
    return (out.select("record", "name", count.alias("copies")).filter("copies > 0")
            .select("record", "name", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica")))


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Global shuffle: a hash of seed, name and replica picks the partition and the place in it (``mix_key``)."""
    key = F.md5(F.concat_ws("/", F.lit(f"order-{seed}"), "name", F.col("replica").cast("string")))
    return rows.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: int = 42,
        target_rows: int | None = None) -> DataFrame:
    """Rows of ``docs`` at the target weights in shuffled order, with ``replica`` and ``mix_key``."""
    rows = shuffled(replicated(docs, weights, default_weight, seed, target_rows), seed)
    own = [name for name in docs.columns if name not in ("replica", "mix_key")]
    return rows.select(*fields_of(own), "replica", "mix_key")


def mixed_rows(docs: DataFrame, weights: dict[str, float], **parameters) -> DataFrame:
    """Like ``mix`` with just the columns of ``docs``, all as they were."""
    return shuffled(replicated(docs, weights, **parameters)).select(*fields_of(docs.columns))
