"""SimHash near-duplicates found through vantage-point trees.

Fingerprints within ``max_bits`` are searched in a forest over ``blocks`` cuts of
the 64 bits. With more blocks than ``max_bits``, two such fingerprints agree on at
least ``blocks - max_bits`` blocks, so there is one tree for each choice of so many
blocks, searched with radius 0; with fewer blocks there is one tree a block,
searched with radius ``max_bits // blocks`` (pigeonhole principle). A vantage-point
tree parts the fingerprints by the Hamming distance of its blocks: all nodes of a
level share a vantage point ``v`` and a fingerprint goes to the inner side if
``d(x, v) <= r``. By the triangle inequality a partner lies within the radius of
that distance, so a branch is pruned unless the shell ``d - radius .. d + radius``
reaches over ``r``; a fingerprint near a boundary also goes to the shard across it.

Over all 64 bits distances crowd at 32 +- 4: a search of radius 4 would visit
both sides of two nodes in three and compare a third of all pairs. Five blocks
give 5 trees of 12 or 13 bits, good for up to some 10**8 different fingerprints;
beyond, 6 blocks give 15 trees of 21 bits and 7 blocks 35 trees of 27.

Inside a shard whole distances are compared and each fingerprint is tied to the
smallest one it reaches there: as many links as members, never all pairs.
Shards larger than ``SHARD_ROWS`` are cut into parts, and every pair of parts
is searched by a task of its own. Links from all shards then meet in connected
components over distinct fingerprints.

Input ``doc_id``, ``text``. Null or blank texts have fingerprint zero and link
like any other. Repeated rows give repeated results; a component whose ids are
all null has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import fields_of, prepare, stored, whole_row

SHARD_ROWS = 20_000
SEED = 42
SALTS = 32           # parts of a large component in joins and aggregates


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])), "<u8",
                       len(words) - size + 1)


def fingerprint(text: str, size: int) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; signed."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The integer columns ``names`` and ``fp``; one narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py() or "", size) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(fp, pa.int64())], names=[*names, "fp"])

    return (docs.select(*[F.col(name).cast("long") for name in names], F.col("text").cast("string"))
            .mapInArrow(run, ", ".join(f"{name} long" for name in (*names, "fp"))))


def forest(blocks: int, max_bits: int) -> tuple[list[list[tuple[int, int]]], int]:
    """(shift, bits) of the blocks of each tree, and the search radius."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    if blocks <= max_bits:
        return [[part] for part in parts], max_bits // blocks
    return [list(chosen) for chosen in combinations(parts, blocks - max_bits)], 0


def _both(searched: Column, sides: Column) -> Column:
    """Shards one level down: each searched node's inner (0) or outer (1) side, or both."""
    return F.flatten(F.transform(searched, lambda s: F.transform(sides, lambda side: s * 2 + side)))


def shards_of(fp: Column, parts: list[tuple[int, int]], levels: int, radius: int, seed: int) -> Column:
    """Shards in which the tree of these blocks searches: the home shard and those across near boundaries.

    A level's vantage point is a seeded random value of the blocks and its
    boundary the median distance of random values.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x  # noqa: E731  as a Spark long
    draw = random.Random(f"{seed}-{parts}")
    mask = sum(((1 << bits) - 1) << shift for shift, bits in parts)
    boundary = sum(bits for _, bits in parts) // 2
    searched = F.array(F.lit(0)) if radius else F.lit(0)
    for _ in range(levels):
        vantage = draw.getrandbits(64) & mask
        d = F.bit_count(fp.bitwiseAND(F.lit(signed(mask))).bitwiseXOR(F.lit(signed(vantage))))
        if radius:
            inner, outer = d - radius <= boundary, d + radius > boundary
            sides = F.when(inner & outer, F.array(F.lit(0), F.lit(1))).when(outer, F.array(F.lit(1))).otherwise(
                F.array(F.lit(0)))
            searched = _both(searched, sides)
        else:
            searched = searched * 2 + (d > boundary).cast("int")
    return searched if radius else F.array(searched)


def reachable(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For sorted distinct fingerprints, the position of the smallest one that each
    reaches within this shard. A search front takes what it finds out of the
    candidates, so a tight group of n costs about n comparisons, not n * n."""
    fps = fps.view(np.uint64)  # counting bits of a signed number counts those of its absolute value
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= max_bits
            if near.any():
                found = left[near]
                root[found] = first
                front.extend(found.tolist())
                left = left[~near]
    return root


def links(distinct: DataFrame, max_bits: int, blocks: int, levels: int, seed: int = SEED) -> DataFrame:
    """``a, b`` (fingerprints, a > b): in every shard each member tied to the smallest it reaches."""
    trees, radius = forest(blocks, max_bits)
    searched = [F.struct(F.lit(number).alias("tree"), shards_of(F.col("fp"), parts, levels, radius, seed).alias("shards"))
                for number, parts in enumerate(trees)]
    dealt = (distinct.select("fp", F.explode(F.array(*searched)).alias("t"))
             .select("fp", F.col("t.tree").alias("tree"), F.explode("t.shards").alias("shard")))
    parts = (dealt.groupBy("tree", "shard").count()
             .filter(F.col("count") > SHARD_ROWS)
             .select("tree", "shard", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("parts")))
    # members of an oversized shard: one row for every pair of parts that holds theirs
    cut = dealt.join(parts, ["tree", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cut = (cut.withColumn("part", part).withColumn("other", other)
           .select("tree", "shard", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp"))

    def tie(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(group["fp"].to_numpy(np.int64))
        root = reachable(fps, max_bits)
        tied = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[tied], "b": fps[root[tied]]})

    return cut.groupBy("tree", "shard", "p", "q").applyInPandas(tie, "a long, b long")


def _signature(edges: DataFrame) -> tuple:
    """Count and combined hashes of a set of links: equal for equal sets."""
    row = edges.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``fp, root``: the smallest fingerprint connected with each one that has links.

    Rounds of large-star and small-star joins by aggregation; each round is
    checkpointed and the loop ends when no link changes.
    """
    edges = edges.distinct().checkpoint()
    seen = _signature(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a != b").distinct())
        edges = small.checkpoint()
        before, seen = seen, _signature(edges)
        if seen == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "fp")


def own_components(own: DataFrame, max_bits: int, blocks: int, levels: int) -> DataFrame:
    """``fp, component_id`` of every fingerprint in ``own`` (``doc_id, fp``, stored).

    The smallest id of a component is found by two partial aggregates, by fingerprint and
    by (root, part of it); rows meet it over the fingerprints, of which no copy is sent.
    """
    by_fp = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(by_fp.select("fp"), max_bits, blocks, levels))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    named = by_fp.join(roots, "fp", "left").select("fp", "least_id", "root", salt).checkpoint()
    linked = named.filter("root is not null")  # a component's smallest fingerprint, its root, has none itself
    among = linked.groupBy("root", "salt").agg(F.min("least_id").alias("among"))
    among = among.groupBy(F.col("root").alias("head")).agg(F.min("among").alias("among"))
    heads = (named.filter("root is null").join(among, F.col("fp") == F.col("head"), "left")
             .select("fp", "head", F.least("among", "least_id").alias("component_id")).checkpoint())
    # members of a large component meet their root's id in as many parts
    dealt = heads.filter("head is not null").select(
        F.col("head").alias("root"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return heads.select("fp", "component_id").unionByName(
        linked.join(dealt, ["root", "salt"]).select("fp", "component_id"))


def near_duplicates(docs: DataFrame, size: int = 4, max_bits: int = 4, blocks: int = 5, levels: int = 12) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc id reachable by links of up to ``max_bits`` bits."""
    spark = prepare(docs.sparkSession)
    own = stored(spark, fingerprints(docs, size), "simhash")
    labels = own_components(own, max_bits, blocks, levels).checkpoint()
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 4, max_bits: int = 4, blocks: int = 5, levels: int = 12) -> DataFrame:
    """One row of each component of ``docs``: the smallest id, rows without an id last; all columns are kept.

    Rows are named by number, so neither equal ids nor missing ones mix rows up. Which of several
    rows with the smallest id and different texts stays is the smallest fingerprint's; of rows
    equal in both, the first. Texts are written once, with their number, and not shuffled unless
    the dropped numbers are too many to broadcast.
    """
    spark = prepare(docs.sparkSession)
    numbered = stored(spark, docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs)), "numbered")
    texts = numbered.select("row", F.col("record.doc_id").alias("doc_id"), F.col("record.text").alias("text"))
    own = stored(spark, fingerprints(texts, size, ("row", "doc_id")), "simhash")
    labels = own_components(own.select(F.col("row").alias("doc_id"), "fp"), max_bits, blocks, levels)
    # component by component the first row; counted in parts of a component, then over the parts
    named = own.join(labels, "fp").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row"))
    kept = named.groupBy("component_id", "salt").agg(first.alias("first")).groupBy("component_id").agg(
        F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias("row")).checkpoint()
    return numbered.join(kept, "row", "left_semi").select(*fields_of(docs.columns))
