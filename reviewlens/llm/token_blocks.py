"""Token-id files in patched frame-of-reference blocks.

The ids of a range of documents are one stream, cut into blocks of 128. A
block stores its minimum once and the distances to it at a fixed bit width.
The width is the bit length of a percentile of the distances, whichever of
``PERCENTILES`` makes the block smallest; distances that need more bits keep
their low bits in place and their high bits in an exception list. An index
holds every block's start, and a directory every document's first token.

File (little-endian): magic ``PFR1``, block size u32, then tokens, documents
and blocks as u64; doc ids i64, null flags u8, first tokens u64 (documents + 1);
block starts u32 (blocks + 1), relative to the first block; the blocks. Block:
minimum u32, width u8 (128 added: exceptions take 4 bytes instead of 2),
number of exceptions u8, low bits packed, exception positions u8, high bits.

Files are written in ascending doc id order (null ids first, equal ids by text):
``ids-<partition>-<number>.pfr`` sorted by name. A null text counts as empty;
an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from reviewlens.llm.bpe import Recent
from reviewlens.llm.pretokens import BREAK, pieces, unmarked

MAGIC, BLOCK = b"PFR1", 128
PERCENTILES = (50, 75, 90, 97, 100)
TOKENS_PER_FILE = 2_000_000  # a file ends with the document that reaches this many
CHARS_AT_ONCE = 1_000_000
REMEMBERED = 2_000_000       # pieces that one worker remembers with their ids (up to 350 MB)
HEAD = struct.Struct("<4sIQQQ")
MANIFEST = "file string, tokens long, documents long"
OUTPUT = "file string, doc_id long, first long, n_tokens long, ids_crc32 long"


_HALF = np.zeros(1 << 16, np.uint8)  # bit lengths of 16-bit numbers
for _bits in range(16):
    _HALF[1 << _bits:2 << _bits] = _bits + 1


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 32-bit value needs (0 for 0)."""
    if not values.size or values.max() < 1 << 16:
        return _HALF[values]
    high = values >> 16
    return np.where(high > 0, 16 + _HALF[high], _HALF[values & 0xFFFF]).astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below ``2**width`` as rows of packed bytes."""
    words = np.zeros((len(values), 2 * width + 1), np.uint64)  # one spare word for the last overhang
    wide = values.astype(np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[:, at] |= wide[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= wide[:, i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[:, :2 * width]).view(np.uint8)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``pack``."""
    words = np.ascontiguousarray(packed).view(np.uint64)
    out = np.empty((len(packed), BLOCK), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, at + 1] << np.uint64(64 - shift)
        out[:, i] = value & mask
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts and the bytes of all blocks."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(1, np.uint32), b""
    padded = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    padded[:len(ids)] = ids
    rows = padded.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1)
    gaps = rows - low[:, None]
    needed = np.sort(bit_lengths(gaps), axis=1)
    most = needed[:, -1].astype(np.int64)
    best = np.full(n_blocks, np.iinfo(np.int64).max)
    widths = np.zeros(n_blocks, np.int64)
    for p in PERCENTILES:
        width = needed[:, (BLOCK - 1) * p // 100]  # bit length of the percentile: lengths keep the order
        over = (needed > width[:, None]).sum(axis=1)
        size = 16 * width.astype(np.int64) + over * np.where(most - width > 16, 5, 3)
        better = size < best
        best, widths = np.where(better, size, best), np.where(better, width, widths)
    body: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        own = gaps[at]
        block = np.zeros((len(at), 6 + 16 * width), np.uint8)
        block[:, :4] = low[at].astype("<u4").view(np.uint8).reshape(-1, 4)
        block[:, 4] = width
        if width:
            block[:, 6:] = pack(own & np.uint32((1 << width) - 1), width)
        high = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
        row, column = np.nonzero(high)
        values = high[row, column]
        counts = np.bincount(row, minlength=len(at))
        wide = np.zeros(len(at), bool)
        np.logical_or.at(wide, row, values > 0xFFFF)
        block[:, 4] += 128 * wide.astype(np.uint8)
        block[:, 5] = counts
        ends, column = np.cumsum(counts).tolist(), column.astype(np.uint8)
        short = values.astype("<u2")
        first = 0
        for i, (k, last) in enumerate(zip(at.tolist(), ends)):
            body[k] = block[i].tobytes()
            if last > first:
                high_bits = values[first:last].astype("<u4") if wide[i] else short[first:last]
                body[k] += column[first:last].tobytes() + high_bits.tobytes()
            first = last
    starts = np.zeros(n_blocks + 1, np.uint32)
    np.cumsum([len(x) for x in body], out=starts[1:])
    return starts, b"".join(body)


def decode_blocks(starts: np.ndarray, body: np.ndarray, n_tokens: int) -> np.ndarray:
    """All ids of a file; blocks of one width are unpacked together."""
    n_blocks = len(starts) - 1
    at = starts[:-1].astype(np.int64)
    head = body[at[:, None] + np.arange(6)] if n_blocks else np.zeros((0, 6), np.uint8)
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    widths, counts = (head[:, 4] & 127).astype(np.int64), head[:, 5].astype(np.int64)
    out = np.empty((n_blocks, BLOCK), np.uint32)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        out[own] = unpack(body[at[own, None] + 6 + np.arange(16 * width)], int(width)) if width else 0
    for large in (0, 1):
        own = np.flatnonzero((counts > 0) & (head[:, 4] >> 7 == large))
        if not len(own):
            continue
        size = 4 if large else 2
        n = counts[own]
        block = np.repeat(own, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = at[block] + 6 + 16 * widths[block]
        column = body[first + k]
        raw = body[(first + counts[block] + size * k)[:, None] + np.arange(size)]
        high = np.ascontiguousarray(raw).view("<u4" if large else "<u2")[:, 0].astype(np.uint32)
        out[block, column] |= high << widths[block].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[:n_tokens]


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    starts, body = encode_blocks(ids)
    first = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=first[1:])
    return b"".join([HEAD.pack(MAGIC, BLOCK, len(ids), len(doc_ids), len(starts) - 1),
                     np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
                     np.array([x is None for x in doc_ids], np.uint8).tobytes(),
                     first.tobytes(), starts.astype("<u4").tobytes(), body])


class TokenFile:
    """A parsed file: ``doc_ids``, ``first`` (documents + 1) and ``ids()``."""

    def __init__(self, content: bytes):
        magic, block, self.n_tokens, n_docs, n_blocks = HEAD.unpack_from(content)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token file")
        raw, at = np.frombuffer(content, np.uint8), HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            at += size
            return raw[at - size:at].view(kind)

        ids, null = part("<i8", n_docs), part("u1", n_docs)
        self.doc_ids = [None if missing else i for i, missing in zip(ids.tolist(), null.tolist())]
        self.first = part("<u8", n_docs + 1).astype(np.int64)
        self.starts = part("<u4", n_blocks + 1)
        self.body = raw[at:]

    def ids(self) -> np.ndarray:
        return decode_blocks(self.starts, self.body, self.n_tokens)

    def document(self, k: int) -> np.ndarray:
        """Ids of one document: only the blocks that hold it are decoded."""
        a, b = self.first[k], self.first[k + 1]
        lo, hi = a // BLOCK, -(-b // BLOCK)
        starts = self.starts[lo:hi + 1]
        if b == a:
            return np.zeros(0, np.uint32)
        part = decode_blocks(starts - starts[0], self.body[starts[0]:starts[-1]], (hi - lo) * BLOCK)
        return part[a - lo * BLOCK:b - lo * BLOCK]


def _word(piece: str) -> bool:
    """Letters behind one space or line break."""
    return piece.isalpha() or (piece[:1] == BREAK and piece[1:].isalpha())


class PieceTokenizer:
    """The library's tokenizer behind a bounded memory of pieces already encoded.

    Pieces are cut where no pre-token can cross (see ``pretokens``), so their
    ids in a row are the ids of the whole text. Marks behind letters are a
    pre-token of their own, and words of letters with a space or line break in front
    stay apart when joined, so new words go to the library as one text and are
    told apart by the bytes that each token stands for. A text that holds the string of
    an added token goes to the library whole; unless ``special_tokens`` is set, such
    strings are ordinary text.
    """

    def __init__(self, definition: str, special_tokens: bool = True):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not special_tokens
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added and special_tokens else None
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)         # byte-level: one character for each byte
        self.known = Recent(REMEMBERED)
        self.marks = Recent(REMEMBERED // 8)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of the pieces that ``_word`` accepts."""
        if not words:
            return []
        texts = [unmarked(word) for word in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.token_bytes[ids])
        cuts = np.cumsum([len(text.encode()) for text in texts])
        at = [0, *(4 * (np.searchsorted(ends, cuts) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _marks(self, marks: set[str]) -> dict[str, bytes]:
        """Ids of runs of ASCII punctuation."""
        found = {mark: self.marks.young.get(mark) or self.marks.old.get(mark) for mark in marks}
        new = [mark for mark, ids in found.items() if ids is None]
        found.update(zip(new, self._ids(new)))
        self.marks.put_all(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, older = self.known.young, self.known.old
        whole = self.added.search if self.added else lambda text: None
        cuts = [(None if whole(text) else pieces(text)) if text else [] for text in texts]
        found = [None if cut is None else list(map(known.get, cut)) for cut in cuts]
        gaps: list[tuple[list, int, str]] = []
        for cut, ids in zip(cuts, found):
            i = -1
            for _ in range(ids.count(None) if ids else 0):
                i = ids.index(None, i + 1)
                gaps.append((ids, i, cut[i]))
        new: dict[str, bytes] = {}
        words, others, ends = {}, [], []
        for piece in {piece for _, _, piece in gaps}:
            stem = piece.rstrip(punctuation)
            if piece in older:
                new[piece] = older[piece]
            elif not _word(stem):
                others.append(piece)
            else:
                if stem != piece:
                    ends.append((piece, stem))
                if stem not in known and stem not in older:
                    words[stem] = None
        stems = dict(zip(words, self._words(list(words))))
        new.update(stems)
        new.update(zip(others, self._ids([unmarked(piece) for piece in others])))
        marks = self._marks({piece[len(stem):] for piece, stem in ends})
        for piece, stem in ends:
            new[piece] = (stems.get(stem) or known.get(stem) or older[stem]) + marks[piece[len(stem):]]
        for ids, i, piece in gaps:
            ids[i] = new[piece]
        self.known.put_all(new)
        uncut = iter(self._ids([text for text, cut in zip(texts, cuts) if cut is None]))
        return [next(uncut) if ids is None else b"".join(ids) for ids in found]


_TOKENIZERS: dict[tuple[str, bool], PieceTokenizer] = {}


def worker_tokenizer(definition: str, special_tokens: bool = True) -> PieceTokenizer:
    key = (hashlib.sha256(definition.encode()).hexdigest(), special_tokens)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to cores
        _TOKENIZERS[key] = PieceTokenizer(definition, special_tokens)
    return _TOKENIZERS[key]


def encoded(tokenizer: PieceTokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """Documents with their ids, encoded ``CHARS_AT_ONCE`` characters (or one text) at a time."""
    doc_ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids.append(doc_id)
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= CHARS_AT_ONCE:
                yield from zip(doc_ids, tokenizer.encode(texts))
                doc_ids, texts, chars = [], [], 0
    yield from zip(doc_ids, tokenizer.encode(texts))


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str,
                      tokens_per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Plan that encodes ``doc_id, text`` and writes the files; run it by writing its rows (the manifest).

    Texts are dealt by ranges of doc_id and encoded while they stream by, so a
    task holds one file's ids at most. A file appears under its name only when
    complete, and a repeated task attempt writes the same bytes again.
    """
    made, place = pafs.FileSystem.from_uri(folder)
    made.create_dir(place, recursive=True)  # also there if no row comes
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(definition.value)
        end = struct.pack("<I", end_id)
        fs, path = pafs.FileSystem.from_uri(folder)
        partition, number = TaskContext.get().partitionId(), 0
        doc_ids, lengths, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            name = f"ids-{partition:07d}-{number:05d}.pfr"
            content = file_bytes(doc_ids, lengths, np.frombuffer(b"".join(parts), "<u4"))
            unfinished = f"{path}/_unfinished-{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(unfinished) as out:
                out.write(content)
            if fs.get_file_info(f"{path}/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{path}/{name}")  # an earlier attempt's, of the same bytes; not every store renames over it
            fs.move(unfinished, f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "tokens": [sum(lengths)], "documents": [len(doc_ids)]})
            doc_ids.clear(), lengths.clear(), parts.clear()
            number, held = number + 1, 0
            return row

        gc.disable()  # the loop makes no reference cycles; looking for them visits every piece held
        try:
            for doc_id, ids in encoded(tokenizer, batches):
                ids += end
                doc_ids.append(doc_id)
                lengths.append(len(ids) >> 2)
                parts.append(ids)
                held += len(ids) >> 2
                if held >= tokens_per_file:
                    yield flush()
            if doc_ids:
                yield flush()
        finally:
            gc.enable()

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .repartitionByRange(F.col("doc_id").asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
            .mapInArrow(run, MANIFEST))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents found in the files: ids' place in their file, number and crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                found = TokenFile(content.as_buffer())
                ids, first = memoryview(found.ids().astype("<u4")).cast("B"), found.first.tolist()
                yield pa.RecordBatch.from_pydict({
                    "file": [path.as_py().rsplit("/", 1)[-1]] * len(found.doc_ids),
                    "doc_id": pa.array(found.doc_ids, pa.int64()), "first": first[:-1],
                    "n_tokens": np.diff(found.first),
                    "ids_crc32": [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(first, first[1:])]})

    return (spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.pfr").load(folder)
            .select("path", "content").mapInArrow(run, OUTPUT))


def with_starts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, over all files.

    The manifest has one row a file (a few bytes for megabytes of ids), so its
    running sum in one task stays small.
    """
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    return (found.join(offsets, "file")
            .select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))
