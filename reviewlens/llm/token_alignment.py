"""Alignment of two tokenizers and corpus-wide counts of the id pairs they link.

Tokenizer A is a byte-level BPE of the tokenizers library, read over a space and the
text; B is a sentencepiece model, which adds that space itself. Both then spell the
same bytes, and offsets where tokens of both end cut a document into groups. A link is
a token of A and one of B whose byte ranges overlap; an id pair's count is the number
of links of the corpus that hold it.

1. One pass over the texts encodes and aligns them piece by piece; ids are stored, two bytes each.
2. The distinct linked pairs are found and dealt by hash to segments of about
   ``SEGMENT_PAIRS``; one task a segment builds its minimal perfect hash.
3. Counting pass: each task adds its links to dense vectors indexed by the hash,
   and the vectors are summed by segment in a tree of two levels.
4. Second pass over the documents: aligned again, counts looked up (verified keys).

``SEGMENTS_AT_ONCE`` segments are broadcast at a time (at most some ten million
keys, 17 bytes each); more pairs take more rounds of passes 3 and 4, whose sums add
up, so the same steps hold for any number of pairs. The highest count of each B id
(one row a vocabulary entry) is broadcast.

Texts null, empty, or that the two spell differently have no tokens: zeros, and an
empty digest. Very long texts are one row as any other. Repeated rows count again and
stay. An empty table gives no rows. Other columns are ignored. Strings of special
tokens inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.llm.bpe import Recent
from reviewlens.llm.common import stored
from reviewlens.llm.perfect_hash import PerfectHash, mixed
from reviewlens.llm.pretokens import BREAK, pieces, unmarked
from reviewlens.llm.token_blocks import PieceTokenizer

SEGMENT_PAIRS = 1 << 16
SEGMENTS_AT_ONCE = 128
COUNT_TASKS = 4096      # most tasks of a counting pass: each sends one vector a segment
CHARS_AT_ONCE = 1_000_000
MERGE_PAIRS = 1 << 22   # id pairs that a task holds before it merges them
TOKENS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "a_ids binary, b_ids binary")
SEED = 0x5EED
REMEMBERED = 600_000    # aligned pieces that one worker remembers (some 200 MB)
SMALL_MEMORY = 20_000
MARK, WHITE = "\u2581", " \n"


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes
    in order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Piece(NamedTuple):
    """A text between two places where tokens of both end: ids, groups (each ended by ``;``) and counts."""

    a: bytes
    b: bytes
    groups: str
    n_groups: int
    n_links: int


NOTHING = Piece(b"", b"", "", 0, 0)


class Pair:
    """Both tokenizers with the bytes that their ids stand for.

    Texts are cut in front of single spaces and line breaks, where neither tokenizer's tokens
    reach across (see ``pretokens``; no piece of B holds a space mark behind another character, or
    a line break). Both sides of a cut are aligned apart, and pieces met before are not
    encoded or aligned again. Other texts are encoded whole.
    """

    def __init__(self, definition_a: str, model_b: bytes):
        self.a = PieceTokenizer(definition_a, special_tokens=False)
        self.a.known = Recent(SMALL_MEMORY)  # what is remembered here are whole pieces
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        alphabet = byte_of_character()
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(MARK, " ").encode()
                        for i, name in enumerate(names)]
        self.cuts_hold = not any("\n" in name or MARK in name.lstrip(MARK) for name in names) and MARK in names
        self.a_texts = np.array([[f"{i},", f"{i}|"] for i in range(len(self.a_bytes))], object)
        self.b_texts = np.array([[f"{i},", f"{i};"] for i in range(len(self.b_bytes))], object)
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.kind = id_kind(len(self.a_bytes), len(self.b_bytes))
        self.memory = Recent(REMEMBERED)

    def aligned(self, texts: list[str], a: np.ndarray, b: np.ndarray) -> list[Piece] | None:
        """The alignment of each of ``texts`` from the tokens of all of them end to end, None if
        those do not spell the texts or reach across."""
        want = [text.encode("utf-8", "surrogatepass") for text in texts]
        joined = b"".join(want)
        if (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != joined
                or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != joined):
            return None
        both = Alignment(self.a_length[a], self.b_length[b])
        ends = np.cumsum([len(x) for x in want])
        if not both.last_group[np.searchsorted(both.ends, ends)].all():
            return None
        a_cut, b_cut = np.searchsorted(both.a_ends, ends, "right"), np.searchsorted(both.b_ends, ends, "right")
        links = np.searchsorted(both.ends, ends, "right")
        groups = np.cumsum(both.last_group)[links - 1]
        # an id's decimal text and what follows it inside a group or at its group's end, groups in order
        words = np.concatenate([self.a_texts[a, np.append(both.a_group[1:] != both.a_group[:-1], True).astype(int)],
                                self.b_texts[b, np.append(both.b_group[1:] != both.b_group[:-1], True).astype(int)]])
        order = np.argsort(np.concatenate([2 * both.a_group, 2 * both.b_group + 1]), kind="stable")
        words, size = words[order].tolist(), np.dtype(self.kind).itemsize
        a_raw, b_raw = a.astype(self.kind).tobytes(), b.astype(self.kind).tobytes()
        cuts = np.stack([a_cut, b_cut, links, groups], axis=1).tolist()
        out, last = [], [0, 0, 0, 0]
        for cut in cuts:
            out.append(Piece(a_raw[size * last[0]:size * cut[0]], b_raw[size * last[1]:size * cut[1]],
                             "".join(words[last[0] + last[1]:cut[0] + cut[1]]), cut[3] - last[3], cut[2] - last[2]))
            last = cut
        return out

    def whole(self, text: str) -> Piece:
        """A text by both libraries at once; nothing if they spell it differently."""
        a = np.frombuffer(self.a.encode([" " + text])[0], "<u4")
        found = self.aligned([" " + text], a, np.array(self.b.encode(text), np.int64))
        return found[0] if found else NOTHING

    def fresh(self, marked: list[str]) -> dict[str, Piece]:
        """New pieces aligned. Those that do not end in white space go to the libraries as one text, which
        starts with a space; the others, and all if that fails, are left to whole texts."""
        joined = sorted((p for p in marked if p and not p[-1].isspace() and p != BREAK), key=lambda p: p[0] == BREAK)
        if not joined or joined[0][0] == BREAK:
            return {}
        texts = [unmarked(p) for p in joined]
        text = "".join(texts)
        a = np.array(self.a.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        found = self.aligned(texts, a, np.array(self.b.encode(text[1:]), np.int64))
        return dict(zip(joined, found)) if found else {}

    def align(self, texts: list[str]) -> list[list[Piece]]:
        """The aligned pieces of each text; none for texts that the tokenizers spell differently."""
        young, old = self.memory.young, self.memory.old
        cuts = [pieces(" " + text) if text and self.cuts_hold and text[0] not in WHITE and "  " not in text else None
                for text in texts]
        missing = {p for cut in cuts if cut for p in cut[1:] if p not in young}
        new = {p: old[p] for p in missing if p in old}
        new.update(self.fresh([p for p in missing if p not in new]))
        found = [None if cut is None else [young.get(p) or new.get(p) for p in cut[1:]] for cut in cuts]
        self.memory.put_all(new)
        return [[NOTHING] if not text else [self.whole(text)] if own is None or None in own else own
                for text, own in zip(texts, found)]


def id_kind(*sizes: int) -> str:
    return "<u2" if max(sizes) <= 1 << 16 else "<u4"


class Alignment:
    """Links of documents put end to end. Each overlapping pair of tokens shares one stretch
    between neighbouring ends, so there is one link for every offset where any token ends."""

    def __init__(self, a_length: np.ndarray, b_length: np.ndarray):
        a_ends, b_ends = np.cumsum(a_length), np.cumsum(b_length)
        total = int(a_ends[-1]) if len(a_ends) else 0
        a_mark, b_mark = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        a_mark[a_ends], b_mark[b_ends] = True, True
        self.a_ends, self.b_ends, self.ends = a_ends, b_ends, np.flatnonzero(a_mark | b_mark)
        a_here, b_here = a_mark[self.ends], b_mark[self.ends]
        self.a_at = np.cumsum(a_here) - a_here      # token of A and of B on each stretch
        self.b_at = np.cumsum(b_here) - b_here
        self.last_group = a_here & b_here           # stretches that end a group
        group = np.cumsum(self.last_group) - self.last_group
        self.a_group, self.b_group = group[a_here], group[b_here]


_PAIRS: dict[str, Pair] = {}


def worker_pair(definition_a: str, model_b: bytes) -> Pair:
    key = hashlib.sha256(definition_a.encode() + model_b).hexdigest()
    if key not in _PAIRS:
        _PAIRS[key] = Pair(definition_a, model_b)
    return _PAIRS[key]


def vocabulary_files(spark: SparkSession, tokenizer_a: str, model_b: str):
    """Both files' contents, broadcast (a few megabytes)."""
    with open(tokenizer_a, encoding="utf-8") as a, open(model_b, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def tokens(docs: DataFrame, files) -> DataFrame:
    """Ids of both tokenizers and the groups of every document; one narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_pair(*files.value)
        size = np.dtype(pair.kind).itemsize
        for batch in batches:
            for start, stop in text_runs(batch.column(2)):
                found = pair.align([x or "" for x in batch.column(2).slice(start, stop - start).to_pylist()])
                a_ids = [b"".join([p.a for p in own]) for own in found]
                b_ids = [b"".join([p.b for p in own]) for own in found]
                groups = ["".join([p.groups for p in own])[:-1].encode() for own in found]
                numbers = {"n_a": [len(x) // size for x in a_ids], "n_b": [len(x) // size for x in b_ids],
                           "n_groups": [sum([p.n_groups for p in own]) for own in found],
                           "n_links": [sum([p.n_links for p in own]) for own in found]}
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column(0).slice(start, stop - start), "doc_id": batch.column(1).slice(start, stop - start),
                    **{k: pa.array(v, pa.int64()) for k, v in numbers.items()},
                    "groups_sha256": pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in groups], pa.string()),
                    "a_ids": pa.array(a_ids, pa.binary()), "b_ids": pa.array(b_ids, pa.binary())})

    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                        F.col("text").cast("string")).mapInArrow(run, TOKENS))


def text_runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHARS_AT_ONCE`` bytes of text or bytes, one row at least."""
    sizes = np.array([x or 0 for x in pc.binary_length(column).to_pylist()], np.int64)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= CHARS_AT_ONCE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def aligned(batch: pa.RecordBatch, a_length: np.ndarray, b_length: np.ndarray, kind: str):
    """For runs of rows ``a_ids, b_ids`` (the last two columns): first and last row, the ids of both
    sides of every link, and the number of links of each row."""
    a_column, b_column = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for start, stop in text_runs(a_column):
        rows = range(start, stop)
        a_raw, b_raw = [a_column[i].as_py() for i in rows], [b_column[i].as_py() for i in rows]
        a, b = np.frombuffer(b"".join(a_raw), kind), np.frombuffer(b"".join(b_raw), kind)
        ends = np.zeros(len(a_raw) + 1, np.int64)
        size = np.dtype(kind).itemsize
        np.cumsum([len(x) // size for x in a_raw], out=ends[1:])
        if not len(a):
            yield start, stop, a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a_raw), np.int64)
            continue
        align = Alignment(a_length[a], b_length[b])
        # links are in the order of A's tokens, which are in the order of the rows
        links = np.diff(np.searchsorted(align.a_at, ends))
        yield start, stop, a[align.a_at].astype(np.uint64), b[align.b_at].astype(np.uint64), links


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << np.uint64(32) | b


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys, SEED) >> np.uint64(32)) % np.uint64(segments)


class Counter:
    """The broadcast part of the index: hashes of some segments, laid end to end."""

    def __init__(self, segments: int, hashes: dict[int, bytes], counts: dict[int, bytes] | None = None):
        self.segments = segments
        self.hashes = {s: PerfectHash.from_bytes(blob) for s, blob in hashes.items()}
        self.first, self.size = {}, 0
        for s in sorted(self.hashes):
            self.first[s] = self.size
            self.size += len(self.hashes[s].keys)
        if counts is not None:
            self.counts = np.zeros(self.size, np.int64)
            for s, raw in counts.items():
                own = np.frombuffer(raw, "<i8")
                self.counts[self.first[s]:self.first[s] + len(own)] = own

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the laid-out vector, -1 for keys of other segments."""
        out = np.full(len(keys), -1, np.int64)
        segment = segment_of(keys, self.segments)
        order = np.argsort(segment, kind="stable")
        cuts = np.searchsorted(segment[order], np.arange(self.segments + 1))
        for s, table in self.hashes.items():
            own = order[cuts[s]:cuts[s + 1]]
            place = table.index(keys[own])
            out[own] = np.where(place >= 0, place + self.first[s], -1)
        return out


def token_lengths(files) -> tuple[np.ndarray, np.ndarray, str]:
    """Bytes of each id of both tokenizers and the stored kind of ids (kept by worker process)."""
    pair = worker_pair(*files.value)
    return pair.a_length, pair.b_length, pair.kind


def distinct_pairs(found: DataFrame, files) -> DataFrame:
    """``key`` of every id pair that some link holds, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_lengths(files)
        held, size = [], 0
        for batch in batches:
            for _, _, a, b, _ in aligned(batch, *lengths):
                held.append(pd.unique(packed(a, b)))
                size += len(held[-1])
                if size > MERGE_PAIRS:
                    held = [pd.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > MERGE_PAIRS // 2:  # a task passes on what it holds and goes on
                        yield pa.RecordBatch.from_pydict({"key": held[0].view(np.int64)})
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"key": pd.unique(np.concatenate(held)).view(np.int64)})

    return found.select("a_ids", "b_ids").mapInArrow(run, "key long").distinct()


def hash_segments(keys: DataFrame, segments: int) -> DataFrame:
    """``segment, hash``: the minimal perfect hash of each segment's keys."""
    schema = "segment int, key long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"segment": segment_of(own, segments).astype(np.int32), "key": batch.column(0)})

    def build(table: pa.Table) -> pa.Table:
        own = table.column("key").to_numpy().view(np.uint64)
        return pa.table({"segment": table.column("segment").slice(0, 1).cast(pa.int32()),
                         "hash": pa.array([PerfectHash.build(own).to_bytes()], pa.binary())})

    return keys.mapInArrow(deal, schema).groupBy("segment").applyInArrow(build, "segment int, hash binary")


def count_vectors(found: DataFrame, files, segments: int, hashes) -> DataFrame:
    """``segment, counts`` of the broadcast segments: every task's dense vectors, summed in a tree."""
    tasks = found.rdd.getNumPartitions()
    fan = max(1, math.isqrt(min(tasks, COUNT_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_lengths(files)
        table = Counter(segments, hashes.value)
        vector = np.zeros(table.size, np.int64)
        for batch in batches:
            for _, _, a, b, _ in aligned(batch, *lengths):
                code, keys = pd.factorize(packed(a, b))
                at, n = table.index(keys), np.bincount(code, minlength=len(keys))
                vector[at[at >= 0]] += n[at >= 0]
        branch = TaskContext.get().partitionId() % fan
        for s, first in table.first.items():
            own = vector[first:first + len(table.hashes[s].keys)]
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([s], pa.int32()), "branch": pa.array([branch], pa.int32()),
                "counts": pa.array([own.astype("<i8").tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = None
        for chunk in table.column("counts").chunks:
            for raw in chunk:
                own = np.frombuffer(raw.as_buffer(), "<i8")
                total = own.copy() if total is None else np.add(total, own, out=total)
        head = table.select(["segment", "branch"]).slice(0, 1)
        return head.append_column("counts", pa.array([total.tobytes()], pa.binary()))

    schema = "segment int, branch int, counts binary"
    parts = found.select("a_ids", "b_ids").coalesce(COUNT_TASKS).mapInArrow(run, schema)
    branches = parts.groupBy("segment", "branch").applyInArrow(add, schema)
    return (branches.withColumn("branch", F.lit(0)).groupBy("segment").applyInArrow(add, schema)
            .select("segment", "counts"))


def pair_counts(indexed: DataFrame) -> DataFrame:
    """``a, b, n``: corpus-wide count of every linked id pair, from ``segment, hash, counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, raw in zip(batch.column(0), batch.column(1)):
                keys = PerfectHash.from_bytes(blob.as_py()).keys
                yield pa.RecordBatch.from_pydict({
                    "a": (keys >> np.uint64(32)).astype(np.int64), "b": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64),
                    "n": np.frombuffer(raw.as_py(), "<i8")})

    return indexed.select("hash", "counts").mapInArrow(run, "a long, b long, n long")


def _whole_sums(row: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``n`` by row (rows in order), exact for any whole numbers."""
    before = np.concatenate([[0], np.cumsum(n)])
    cuts = np.searchsorted(row, np.arange(rows + 1))
    return before[cuts[1:]] - before[cuts[:-1]]


def looked_up(found: DataFrame, files, segments: int, index, best) -> DataFrame:
    """Second pass: ``found`` without ids, with ``n_best`` and ``count_sum`` over the links of the broadcast segments."""
    plain = [name for name in found.columns if name not in ("a_ids", "b_ids")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in plain]
                       + ["n_best long", "count_sum long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_lengths(files)
        hashes, counts = index.value
        table, highest = Counter(segments, hashes, counts), best.value
        for batch in batches:
            for start, stop, a, b, links in aligned(batch, *lengths):
                back, keys = pd.factorize(packed(a, b))
                at = table.index(keys)
                n = np.where(at >= 0, table.counts[at], 0) if table.size else np.zeros(len(keys), np.int64)
                is_best = (n > 0) & (n == highest[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)])
                row = np.repeat(np.arange(stop - start), links)
                n, is_best = n[back], is_best[back]
                sums = np.stack([_whole_sums(row, is_best, stop - start), _whole_sums(row, n, stop - start)]).astype(np.int64)
                part = batch.slice(start, stop - start).select(plain)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums[0]), pa.array(sums[1])],
                                                 names=[*plain, "n_best", "count_sum"])

    return found.select(*plain, "a_ids", "b_ids").mapInArrow(run, schema)


def collected(frame: DataFrame, of: int, to: int) -> list[dict[int, bytes]]:
    """Columns of the segments ``of`` .. ``to - 1`` (a bounded number of bounded rows) by segment."""
    rows = frame.filter((F.col("segment") >= of) & (F.col("segment") < to)).collect()
    return [{r.segment: bytes(r[name]) for r in rows} for name in frame.columns if name != "segment"]


def align(docs: DataFrame, tokenizer_a: str, model_b: str, segment_pairs: int = SEGMENT_PAIRS,
          at_once: int = SEGMENTS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``doc_id, text``) aligned: one row a document, and the table of pair counts ``a, b, n``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    files = vocabulary_files(spark, tokenizer_a, model_b)
    found = stored(spark, tokens(docs, files), "aligned-ids")
    keys = stored(spark, distinct_pairs(found, files), "id-pairs")
    segments = max(1, -(-keys.count() // segment_pairs))
    hashes = stored(spark, hash_segments(keys, segments), "pair-hashes")
    rounds = [(k, k + at_once) for k in range(0, segments, at_once)]
    counted = None
    for k, end in rounds:
        part = count_vectors(found, files, segments, sc.broadcast(collected(hashes, k, end)[0]))
        part = stored(spark, part, "pair-counts")
        counted = part if counted is None else counted.unionByName(part)
    indexed = hashes.join(counted, "segment")
    pairs = stored(spark, pair_counts(indexed), "counted-pairs")
    highest = np.zeros(sentencepiece.SentencePieceProcessor(model_file=model_b).get_piece_size(), np.int64)
    for row in pairs.groupBy("b").agg(F.max("n").alias("n")).collect():  # one row a vocabulary entry at most
        highest[row.b] = row.n
    best = sc.broadcast(highest)
    parts = None
    for k, end in rounds:
        part = looked_up(found, files, segments, sc.broadcast(collected(indexed, k, end)), best)
        parts = part if parts is None else parts.unionByName(part)
    plain = [name for name in found.columns if name not in ("a_ids", "b_ids")]
    summed = parts.groupBy(*plain).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return summed.drop("row"), pairs
