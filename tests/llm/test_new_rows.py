"""Alignment of tokenizers, digest index and spelling variants against brute force; rows that clash or repeat."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlens.llm import (
    cross_polytope, exact_dedup as ed, html_extract, mixing, rule_ensemble, sharding, simhash, spelling, token_alignment as ta,
    token_blocks, toxicity,
)
from reviewlens.llm.common import fields_of, shared_folder, whole_row
from reviewlens.llm.perfect_hash import PerfectHash
from reviewlens.llm.queries import QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# perfect hashing

@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_perfect_hash_is_minimal_and_verified(keys, strangers):
    table = PerfectHash.build(np.array(sorted(keys), np.uint64))
    table = PerfectHash.from_bytes(table.to_bytes())
    own = np.array(sorted(keys), np.uint64)
    assert sorted(table.index(own).tolist()) == list(range(len(keys)))
    other = np.array([x for x in strangers if x not in keys], np.uint64)
    assert (table.index(other) == -1).all()


def test_perfect_hash_of_many_keys():
    keys = np.arange(200_000, dtype=np.uint64) * np.uint64(1 << 20)
    table = PerfectHash.build(keys)
    assert (np.sort(table.index(keys)) == np.arange(len(keys))).all()
    assert sum(map(len, table.levels)) * 64 < 4.5 * len(keys)


# alignment

class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        self.alphabet = ta.byte_of_character()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i)))
             for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
              else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], []
        return a, b


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute_alignment(rows):
    brute, counts, per_row = Brute(), Counter(), []
    for doc_id, text in rows:
        a, b = map(spans, brute.tokens(text))
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        counts.update(links)
        ends = sorted({e for _, _, e in a} & {v for _, _, v in b})
        groups = ";".join(
            ",".join(str(i) for i, _, e in a if lo < e <= hi) + "|" + ",".join(str(j) for j, _, v in b if lo < v <= hi)
            for lo, hi in zip([0, *ends], ends))
        per_row.append((doc_id, a, b, ends, links, groups))
    highest = defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return sorted(((doc_id, len(a), len(b), len(ends), len(links), sum(counts[x] == highest[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if a else "")
                   for doc_id, a, b, ends, links, groups in per_row), key=str), counts


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [(20, "a <|endoftext|> b <s> <unk> </s> <0x41>"), (21, "▁ marks"), (22, "two  spaces\n\n and\ttabs  "), (23, " "),
         (24, "ß straße café é 漢字 \U0001f600"), (25, "Thntonre hand theanontion."), (25, "Thntonre hand theanontion.")]


def test_alignment_against_brute_force(spark, make):
    rows = [(i, t[:3000] if t else t) for i, t in ODD] + TEXTS
    want, counts = brute_alignment(rows)
    for parameters in ({}, {"segment_pairs": 8, "at_once": 3}):  # one segment; many, in several rounds
        found, pairs = ta.align(make(rows).repartition(3), A_FILE, B_FILE, **parameters)
        assert sorted((tuple(r[c] for c in ALIGNED) for r in found.collect()), key=str) == want
        assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)


def test_alignment_of_a_very_long_text_and_of_nothing(spark, make):
    found, _ = ta.align(make(ODD), A_FILE, B_FILE)
    long = [r for r in found.collect() if r.doc_id == 9]
    assert len(long) == 2 and all(r.n_a > 30_000 and r.n_links >= r.n_groups >= 30_000 for r in long)
    found, pairs = ta.align(make([]), A_FILE, B_FILE)
    assert found.count() == 0 and pairs.count() == 0


def test_op11_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(i, t) for i, t in rows if len(t) < 1500]
    got = {r.doc_id: r for r in QUERIES["op11_perfect_hash_alignment"](spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, n_a, n_b, n_groups, n_links, _, _, digest in brute_alignment(short)[0]:
        assert tuple(got[doc_id][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (
            n_a, n_b, n_groups, n_links, digest)


# digest index

def brute_labels(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        at = ids.index(keep)
        out += [(i, keep, len(ids), k == at, digest) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_digest_index_labels(spark, make, batches):
    rows = ODD + [(i, "Alpha" if i % 2 else "aLPHA") for i in range(30, 40)] + [(None, "alone"), (None, "alone"), (40, "Ärger"), (41, "ärger")]
    index = ed.DigestIndex(spark, shared_folder(spark, "index"), buckets=4)
    found = ed.deduplicate_in_batches(make(rows, "digest int, row int, batch string, keep_id long"), index, batches)
    got = found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("d")).collect()
    assert sorted(map(tuple, got), key=str) == brute_labels(rows)


def test_index_persists_and_grows(spark, make):
    folder = shared_folder(spark, "index")
    first = ed.new_texts(make([(1, "a b"), (2, "A b"), (3, "c")], "record int, digest int, nth int"),
                         ed.DigestIndex(spark, folder, 4), "monday")
    assert sorted((r.doc_id, r.text) for r in first.collect()) == [(2, "A b"), (3, "c")]
    again = ed.DigestIndex(spark, folder, 4)
    second = ed.new_texts(make([(9, "C"), (5, "d"), (6, "d"), (7, None), (8, "")]), again, "tuesday")
    assert sorted((r.doc_id, r.text) for r in second.collect()) == [(6, "d"), (8, "")]
    assert ed.new_texts(make([(4, "D")]), again, "wednesday").count() == 0
    assert sorted(r.keep_batch for r in again.table().collect()) == ["monday", "monday", "tuesday", "tuesday"]
    assert ed.new_texts(make([]), again, "empty").count() == 0


def test_index_side_is_not_shuffled_and_plan_is_native(spark, make):
    index = ed.DigestIndex(spark, shared_folder(spark, "index"), 16)
    plan = index.unknown(ed.digests(make([(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "SelectedBucketsCount: 16 out of 16" in plan
    lines = plan.splitlines()
    last = max(k for k, line in enumerate(lines) if line.lstrip().startswith(":"))  # the join's other side ends there
    index_side = "\n".join(lines[last + 1:])
    assert "FileScan" in index_side and "Exchange" not in index_side
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_digest_meets_its_group_by_broadcast(spark, make, monkeypatch):
    rows = [(i, "copy") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(300)]
    monkeypatch.setattr(ed, "HOT_SHARE", 4)
    index = ed.DigestIndex(spark, shared_folder(spark, "index"), 4)
    found = ed.deduplicate_in_batches(make(rows), index, 2)
    assert sum(r.kept for r in found.collect()) == 301 and found.count() == 600


# nearest neighbours: types and lengths

def test_vectors_keep_their_precision_and_lengths_are_apart(spark):
    rng = np.random.default_rng(9)
    data = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in cross_polytope.nearest(df, F.col("id") % 20 == 0, k=4, probes=16).collect()}
    for q in (0, 20, 40):
        x = np.array(data[q][1])
        near = sorted((-float(np.cumsum(x * np.array(v))[-1]), i) for i, v in data if i != q and len(v) == len(x))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in near]


# toxicity: a matcher that looks for every entry by itself

def plain_density(words, model):
    text, by_start = " " + " ".join(words) + " ", {}
    find = lambda entry: [k for k in range(len(text)) if text.startswith(entry, k)]
    for entry, weight in model.weights.items():
        for k in find(entry):
            by_start[k] = max(weight, by_start.get(k, 0.0))
    inside = [(k, k + len(e) - 1) for e in model.exceptions for k in find(e)]
    total = sum(w for k, w in by_start.items() if not any(a <= k < b for a, b in inside))
    return math.log1p(100.0 * total / len(words)) if words and (model.weights or model.exceptions) else 0.0


def test_scores_equal_a_plain_matcher(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "toxic", 5, 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scores(docs, model).collect():
        words = toxicity.fold(texts[r.doc_id])[:400]
        machine = model.automaton()
        assert toxicity.density(words, machine) == pytest.approx(plain_density(words, model), abs=1e-12)
        x = model.bias + model.slope * toxicity.density(toxicity.fold(texts[r.doc_id]), machine)
        assert r.score == pytest.approx(1.0 / (1.0 + math.exp(-min(max(x, -50.0), 50.0))), abs=1e-12)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["trash", "can", "idiot", "idiots", "the", "tra"]), max_size=12))
def test_density_with_overlapping_exceptions(words):
    model = toxicity.ToxicModel({" trash ": 3.0, " tras": 2.0, " idio": 1.5, " can ": 0.5}, (" trash can ", " can idiots ", " trash trash "), 1.0, 0.0)
    assert toxicity.density(words, model.automaton()) == pytest.approx(plain_density(words, model), abs=1e-12)


def test_density_of_a_very_long_text_is_quick():
    model = toxicity.ToxicModel({" trash ": 3.0}, (" trash can ",), 1.0, 0.0)
    start = time.perf_counter()
    toxicity.density(["trash", "can"] * 50_000, model.automaton())
    assert time.perf_counter() - start < 10


def test_deep_and_stray_html_is_quick():
    start = time.perf_counter()
    for html in ("<ul><li>x, y " * 20_000, "<div>some text, here " * 20_000, "<div>a</div>" + "</span>" * 20_000):
        html_extract.main_text(html)
    assert time.perf_counter() - start < 60


# special tokens

def test_special_tokens_are_read_as_the_library_reads_them():
    definition = open(A_FILE, encoding="utf-8").read()
    library = Tokenizer.from_str(definition)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y.", "a  <|endoftext|>", "plain words, here", "<|endoftext|>"]
    plain = Tokenizer.from_str(definition)
    plain.encode_special_tokens = True
    for special, other in ((True, library), (False, plain)):
        got = [np.frombuffer(x, "<u4").tolist() for x in token_blocks.PieceTokenizer(definition, special).encode(texts)]
        assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]


# spelling variants

def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1:] == short for i in range(len(long)))
    forms, out = {}, []
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        forms[w] = (best if best is not None and words[best] >= 10 * n else None, len(around))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.append((w, form, root, words[w], n_near, words[form] if form else None))
    return sorted(out, key=str)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def variants(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_variants_of_odd_rows(spark, make):
    chain = ["letters"] * 3 + ["lettersx"] * 40 + ["lettersxy"] * 500
    text = "colours colors colours Colouring colourinG colouréd colouréd Àbcdefgh àbcdefgh abcdefg abcdefg abcdefgh abcdefgh"
    rows = ODD + [(30, text), (31, text), (None, " ".join(chain)), (32, "abcdefg" * 3 + " " + "abcdefg" * 3)]
    docs = make(rows, "word string, n long, run string, key long")
    assert variants(spelling.variants(docs.repartition(3))) == brute_variants(rows)
    assert {r[2] for r in variants(spelling.variants(docs)) if r[0].startswith("letters")} == {"lettersxy"}
    assert spelling.variants(make([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=7, max_size=12), st.integers(0, 11), st.sampled_from("abcd"), st.sampled_from(["put", "cut", "swap"]))
def test_an_edit_keeps_a_chunk(word, at, letter, how):
    at = min(at, len(word) - 1)
    other = {"put": word[:at] + letter + word[at:], "cut": word[:at] + word[at + 1:],
             "swap": word[:at] + letter + word[at + 1:]}[how]
    long, short = sorted((word, other), key=len, reverse=True)

    def keys(w, more):
        longer, size, out = len(w) + more, (len(w) + more) // 2, set()
        for first, (chunk, rest) in enumerate([(w[:size], w[size:]), (w[len(w) - size:], w[:len(w) - size])]):
            part = (longer - size) // 2
            out |= {(longer, first, 0, chunk, rest[:part]), (longer, first, 1, chunk, rest[len(rest) - part:])}
        return out
    assert keys(long, 0) & keys(short, len(long) - len(short))


def test_op13_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert variants(QUERIES["op13_chunk_join"](spark, SF)) == brute_variants(rows)


# rows and columns that clash

def test_keep_one_names_rows_not_ids(spark, make):
    a, b = "alpha beta gamma delta epsilon", "nothing like the other text at all"
    kept = simhash.keep_one(make([(1, a), (2, a), (2, b)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b)]
    kept = simhash.keep_one(make([(None, a), (None, a), (None, a), (4, a), (None, b), (None, b)], "row int, record int, salt int"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(4, a), (None, b)]


def test_mix_keeps_columns_with_its_own_names(spark, make):
    docs = make([(i, f"t{i}") for i in range(20)], "x int").select(
        "*", F.lit("own").alias("rate"), F.lit(7).alias("copies"), F.lit(8).alias("record"), F.lit(9).alias("name"),
        F.lit(10).alias("a.b"), F.lit(11).alias("replica"))
    mixed = mixing.mix(docs, {}, target_rows=60)
    assert {(r.rate, r.copies, r.record, r["name"], r["a.b"]) for r in mixed.collect()} == {("own", 7, 8, 9, 10)}
    kept = mixing.mixed_rows(docs, {}, target_rows=60)
    assert kept.columns == docs.columns and {r.replica for r in kept.collect()} == {11}


def test_rows_without_id_draw_their_own_counts(spark, make):
    rows = mixing.mix(make([(None, f"text {i}") for i in range(200)]), {}, target_rows=200).collect()
    assert 150 < len(rows) < 250 and len({r.text for r in rows}) > 100


def test_rules_keep_columns_with_their_own_names(spark, make):
    docs = make([(1, "some words here"), (2, "")], "x int").select(
        "*", F.lit("own").alias("quality_words"), F.lit(5).alias("stat_log_chars"), F.lit(6).alias("record"), F.lit(7).alias("a.b"))
    model = rule_ensemble.constant(0.9)
    for out in (rule_ensemble.accepted(docs, model), rule_ensemble.scored(docs, model)):
        assert {(r.quality_words, r.stat_log_chars, r.record, r["a.b"]) for r in out.collect()} == {("own", 5, 6, 7)}
    assert rule_ensemble.accepted(docs, model).columns == docs.columns


def test_shards_keep_columns_and_split_repeated_rows(spark, make, monkeypatch):
    docs = make([(i % 3 or None, "same") for i in range(400)], "bucket int").select("*", F.lit(1).alias("a.b"), F.lit(2).alias("record"))
    monkeypatch.setattr(sharding, "REPEATS", 10)
    rows, n = sharding.scattered(docs, 42, 600)
    assert n == 400 and max(r["count"] for r in rows.groupBy("bucket").count().collect()) < 120
    out = sharding.shuffle_into_shards(docs, 7, bucket_bytes=600)
    found = out.collect()
    assert {(r["a.b"], r.record) for r in found} == {(1, 2)}
    for shard in range(7):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (57, 58)


def test_whole_row_round_trip(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert df.select(whole_row(df)).select(*fields_of(df.columns)).collect() == df.collect()
