"""Byte-level BPE with a hierarchical-bitmap rank queue.

Every adjacent pair that the rank table knows waits in the bucket of its merge
rank, as the position of its left part in a linked list. A two-level bitmap
says which buckets hold something: find-first-set on two words gives the lowest
rank. A merge changes at most two neighbouring pairs; their old
entries stay behind and are skipped as stale when their turn comes. So a
pre-token of n bytes costs O(n log n) however long it is.

Input: ``doc_id``, ``text``; a null text counts as empty and gives no ids.
Rows are encoded one by one: repeated rows give repeated results, an empty
table an empty result, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from string import punctuation

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.pretokens import pieces, unmarked

OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
OUTPUT_IDS = OUTPUT + ", ids binary"
REMEMBERED = 700_000    # pieces that one worker remembers with their ids (up to 140 MB)
LONGEST_REMEMBERED = 64
ROWS_AT_ONCE = 500      # rows whose ids a task holds before it passes them on


class Recent:
    """Ids of short texts met lately, in two generations: when the young one
    fills half of the limit it becomes the old one, and what is used from there moves back."""

    def __init__(self, limit: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = max(1, limit // 2)

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= LONGEST_REMEMBERED:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[key] = ids

    def put_all(self, new: dict[str, bytes]) -> None:
        """Like ``put`` for each; the young generation may pass its half by one batch."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young.update((key, ids) for key, ids in new.items() if len(key) <= LONGEST_REMEMBERED)


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """A rank file: base64 token and rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


class RankQueue:
    """Storage of the queue: two bitmap levels of 256-bit words over the ranks
    and a bucket (a heap of positions) for each rank in use. ``Encoder.merge``
    keeps it in local names, since it runs once for every new pre-token; the
    queue is empty again when a pre-token is done."""

    def __init__(self, n_ranks: int):
        self.leaf = [0] * ((n_ranks >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}


class Encoder:
    """Encodes and decodes texts by a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(len(self.tokens))
        self.by_piece = Recent(REMEMBERED)
        self.by_word = Recent(REMEMBERED // 8)  # pre-tokens of other pieces

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, n = self.ranks, len(word)
        if word in ranks:
            return [ranks[word]]
        if n == 1:
            raise ValueError(f"the rank table has no byte {word!r}")
        longest, get = self.longest, ranks.get
        leaf, buckets, top = self.queue.leaf, self.queue.buckets, 0
        after = list(range(1, n + 2))   # where the next token starts; n: there is none
        before = list(range(-1, n))     # where the token in front starts
        waiting = [-1] * (n + 1)        # rank of the pair that starts here, -1: none
        changed = range(n - 1)          # positions whose pair is new
        while True:
            for i in changed:
                rank = get(word[i:after[after[i]]]) if after[after[i]] - i <= longest else None
                if rank is None:
                    waiting[i] = -1
                    continue
                waiting[i] = rank
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    leaf[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                else:
                    heappush(bucket, i)
            while top:                  # find-first-set: the lowest rank, its leftmost position
                high = (top & -top).bit_length() - 1
                bits = leaf[high]
                rank = (high << 8) + (bits & -bits).bit_length() - 1
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    leaf[high] = bits = bits & (bits - 1)
                    if not bits:
                        top &= top - 1
                if waiting[i] == rank:  # else stale: that pair was merged into or away
                    break
            else:
                break
            j = after[i]
            k = after[i] = after[j]
            waiting[i] = waiting[j] = -1
            h = before[i]
            if k < n:
                before[k] = i
                changed = (i,) if h < 0 else (h, i)
            else:
                changed = () if h < 0 else (h,)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:after[i]]])
            i = after[i]
        return out

    def _word(self, word: str) -> bytes:
        ids = self.by_word.young.get(word)
        if ids is None:
            ids = self.by_word.old.get(word) or array("I", self.merge(word.encode())).tobytes()
            self.by_word.put(word, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, self.pattern.findall(text)))

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the young generation lacks. A piece of letters is one
        pre-token; ASCII punctuation behind letters is a pre-token of its own."""
        ids = self.by_piece.old.get(piece)
        if ids is None:
            stem = piece.rstrip(punctuation)
            if not stem.isalpha():
                ids = self._plain(unmarked(piece))
            elif stem == piece:
                ids = array("I", self.merge(b" " + piece.encode())).tobytes()
            else:
                ids = (self.by_piece.young.get(stem) or self._piece(stem)) + self._word(piece[len(stem):])
        self.by_piece.put(piece, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        cut = pieces(text)
        if cut is None:
            return self._plain(text)
        found = list(map(self.by_piece.young.get, cut))
        i = -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            found[i] = self.by_piece.young.get(cut[i]) or self._piece(cut[i])
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def worker_encoder(blob: bytes, pattern: str) -> Encoder:
    """One encoder for each rank file in a Python worker, kept between tasks."""
    key = (hashlib.sha256(blob).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(blob), pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes per document.

    The rank file (about 1 MB) is read on the driver and broadcast, so workers
    need no file of their own. One narrow pass over the texts, no shuffle.
    """
    with open(rank_file, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(blob.value, pattern)
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            counts, digests, decoded, kept = [], [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids) >> 2)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                       pa.array(decoded, pa.string())] + ([pa.array(kept, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                                             + (["ids"] if with_ids else []))

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, OUTPUT_IDS if with_ids else OUTPUT))
