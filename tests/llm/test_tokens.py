"""Token files and BPE: round trips and the public libraries as brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reviewlens.llm import bpe, token_blocks as tb
from reviewlens.llm.common import shared_folder, stored
from reviewlens.llm.pretokens import pieces, unmarked
from reviewlens.llm.queries import QUERIES
from tests.llm.conftest import ODD

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
with open(RANKS, "rb") as f:
    TABLE = bpe.parse_ranks(f.read())
ENCODER = bpe.Encoder(TABLE, P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=TABLE, special_tokens={})
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def expected(text):
    return np.array(REFERENCE.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab  \n\t'st\x00\x01\x1c\x85 é漢1.!"), st.characters(codec="utf-8"))))
def test_bpe_equals_the_library_and_round_trips(text):
    ids = ENCODER.encode(text)
    assert ids == expected(text)
    assert ENCODER.decode(ids) == text.encode()


LIBRARY = tb.PieceTokenizer(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abé漢 \n.,!'\"$s1\t\x00"), st.characters(codec="utf-8"))), max_size=4))
def test_pieces_through_the_library_equal_whole_texts(texts):
    want = [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert LIBRARY.encode(texts) == want
    assert [ENCODER.encode(t) for t in texts] == [expected(t) for t in texts]


def test_bpe_on_long_pretokens():
    rng = random.Random(3)
    text = "".join(rng.choice("abcst") for _ in range(5_000))
    assert ENCODER.encode(text) == expected(text)
    long = "a" * 300_000
    assert ENCODER.decode(ENCODER.encode(long)) == long.encode()
    assert ENCODER.queue.buckets == {} and not any(ENCODER.queue.leaf)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    monkeypatch.setattr(tb, "REMEMBERED", 4)
    encoder = bpe.Encoder(TABLE, P.PATTERN)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        library = tb.PieceTokenizer(f.read())
    text = " ".join(f"word{chr(97 + i % 23)}{'.,!'[i % 3] if i % 5 == 0 else ''}" for i in range(500)) + "\n\n\nend  "
    assert encoder.encode(text) == expected(text)
    for _ in range(3):
        got = library.encode([text, "", text[:60], "Word. word, word.\nword"])
        assert got == [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                       for t in (text, "", text[:60], "Word. word, word.\nword")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t. "))
def test_pieces_join_to_the_text(text):
    cut = pieces(text) if text else []
    assert cut is None or "".join(map(unmarked, cut)) == text


def test_encode_documents_odd_rows(spark, make):
    rows = bpe.encode_documents(make(ODD), RANKS, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(ODD)
    got = sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in rows)
    want = sorted((i is not None, i, len(expected(t or "")) // 4, hashlib.sha256(expected(t or "")).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest(), expected(t or "")) for i, t in ODD)
    assert got == want
    assert bpe.encode_documents(make([]), RANKS, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    starts, body = tb.encode_blocks(ids)
    assert (tb.decode_blocks(starts, np.frombuffer(body, np.uint8), len(ids)) == ids).all()


def test_blocks_store_exceptions_apart():
    ids = np.full(tb.BLOCK * 3, 7, np.uint32)
    ids[5], ids[200], ids[300] = 40_000, 2**32 - 1, 8
    starts, body = tb.encode_blocks(ids)
    assert len(body) < 3 * 6 + 20 + tb.BLOCK // 8
    assert (tb.decode_blocks(starts, np.frombuffer(body, np.uint8), len(ids)) == ids).all()


def test_file_gives_single_documents():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 127, 128, 129, 1000]
    ids = rng.integers(0, 50_000, sum(lengths)).astype(np.uint32)
    found = tb.TokenFile(tb.file_bytes([4, None, 6, 7, 8, 9], lengths, ids))
    assert found.doc_ids == [4, None, 6, 7, 8, 9] and (found.ids() == ids).all()
    at = 0
    for k, n in enumerate(lengths):
        assert (found.document(k) == ids[at:at + n]).all()
        at += n
    with pytest.raises(ValueError):
        tb.TokenFile(b"XXXX" + bytes(60))


def brute_starts(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for i, t in ordered:
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def written(spark, docs, **more):
    folder = shared_folder(spark, "token-test")
    manifest = stored(spark, tb.write_token_files(docs, P.path("byte_bpe_50k.json"), 2, folder, **more), "token-test-manifest")
    return tb.with_starts(tb.read_token_files(spark, folder), manifest)


def test_token_files_odd_rows(spark, make):
    rows = [tuple(r) for r in written(spark, make(ODD), tokens_per_file=50).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(rows, key=key) == sorted(brute_starts(ODD), key=key)


def test_token_files_of_an_empty_table(spark, make):
    folder = shared_folder(spark, "token-test")
    manifest = stored(spark, tb.write_token_files(make([]), P.path("byte_bpe_50k.json"), 2, folder), "token-test-manifest")
    assert manifest.count() == 0
    assert tb.with_starts(tb.read_token_files(spark, folder), manifest).count() == 0


def test_op1_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_blocks"](spark, sf).collect())
    assert got == sorted(brute_starts(docs))


def test_op9_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_rank_queue_bpe"](spark, sf).collect():
        ids = expected(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
