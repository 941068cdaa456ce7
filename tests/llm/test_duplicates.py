"""SimHash trees, paragraph sketches and vector search against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewlens.llm import cross_polytope as cp, paragraph_sketch as ps, simhash as sh
from reviewlens.llm.queries import QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=4):
    """(id, fingerprint) -> smallest id reachable."""
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB é\n\t\x0b\x1c "))
def test_fingerprint(text):
    assert sh.fingerprint(text, 4) & (1 << 64) - 1 == brute_fingerprint(text)


def test_simhash_odd_rows(spark, make):
    assert found(sh.near_duplicates(make(ODD))) == brute_components(ODD)
    assert sh.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("blocks,levels", [(5, 12), (6, 14), (3, 4), (2, 3), (1, 3)])
def test_every_forest_finds_every_link(spark, blocks, levels):
    """Chains of near fingerprints, boundary cases included, for radius 0, 1, 2 and 4."""
    rng = np.random.default_rng(blocks)
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 2**63))
        for _ in range(6):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = {}
    for x in signed:
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            near = [z for z in signed if z not in seen and ((y ^ z) & (1 << 64) - 1).bit_count() <= 4]
            seen.update(near)
            todo.extend(near)
        want[x] = min(seen)
    edges = sh.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, blocks, levels)
    got = {r.fp: r.root for r in sh.components(edges).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_oversized_shards_are_cut_and_lose_nothing(spark, make, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_ROWS", 3)
    rows = [(i, f"same words in every row but one {i % 17} of them " * 3) for i in range(60)] + [(100, "x"), (101, "x")]
    assert found(sh.near_duplicates(make(rows), levels=1)) == brute_components(rows)


def test_keep_one(spark, make):
    docs = make([(4, "alpha beta gamma delta"), (2, "Alpha beta  gamma delta"), (8, "something else entirely here now"),
                 (None, "something else entirely here now"), (None, "alone"), (8, "something else entirely here now")])
    kept = sh.keep_one(docs)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "8", "None"]
    assert kept.columns == docs.columns


def test_op10_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_trees"](spark, SF).collect()), key=str)
    assert got == brute_components(docs)


# paragraph sketches

def brute_digests(text):
    pieces = [""]
    for w in re.findall(ps.WORD, text):
        if w == "\n":
            pieces.append("")
        else:
            pieces[-1] += w
            if xxhash.xxh64(w.rstrip(" ").encode(), seed=42).intdigest() % ps.CUT_WORDS == 0:
                pieces.append("")
    assert "".join(pieces) == text.replace("\n", "")
    return {p for p in pieces if p}


def brute_sketch_rows(rows):
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else ps.NO_ID), r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text)
        edited = text[:n - n // 2] + after[:n // 2]

        def like(a, b):
            a, b = brute_digests(a), brute_digests(b)
            return len(a & b) / len(a | b) if a | b else 1.0
        out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), round(like(text, edited), 12), round(like(text, after), 12)))
    return sorted(out, key=str)


def sketch_rows(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()), key=str)


def test_sketches_odd_rows(spark, make):
    long = "\n".join(f"line {i} of a long text" for i in range(900))
    rows = ODD + [(2000, long), (1999, long + "\nand one more"), (5_000_000, "far away")]
    df = ps.fingerprints(make(rows))
    assert sketch_rows(df) == brute_sketch_rows(rows)
    prints = {}
    for r in df.collect():
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and prints[(2, 30)] == prints[(7, 30)]
    assert ps.fingerprints(make([])).count() == 0
    one = ps.fingerprints(make([(1, "alone")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aloal"[:5]).hexdigest()


def test_sketches_without_retries_fall_back_to_digests(spark, make, monkeypatch):
    monkeypatch.setattr(ps, "RETRIES", 0)
    monkeypatch.setattr(ps, "PART_DIGESTS", 60)
    rows = [(i, "\n".join(f"text {i} line {k}" for k in range(40))) for i in range(6)]
    assert sketch_rows(ps.fingerprints(make(rows))) == brute_sketch_rows(rows)


def test_word_pieces_of_odd_rows(spark, make):
    rows = ODD + [(20, "漢字かな交じり文、" * 40 + "ไทย" * 30), (21, "字" + "漢字かな交じり文、" * 40), (22, "\ttab\r\n\n \x0b it's  'quoted'\\n \f")]
    assert sketch_rows(ps.fingerprints(make(rows))) == brute_sketch_rows(rows)


def test_inserts_and_deletes_touch_few_pieces(spark, make):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 5000, 2000)]
    short = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    cut = set(rng.choice(2000, 20, replace=False).tolist())
    rows = [(8, " ".join(words)), (7, " ".join(w for i, w in enumerate(words) if i not in cut)),
            (6, " ".join(short)), (5, "first " + " ".join(short)), (4, "first " + " ".join(short[:150] + ["new"] + short[150:])),
            (3, " ".join(short[:150] + short[151:])), (2, " ".join(short[:-10]))]
    near = {r.doc_id: r.near_next for r in ps.fingerprints(make(rows)).collect()}
    assert near[8] > 0.65 and near[6] > 0.8 and near[5] > 0.8 and near[4] > 0.6 and near[3] > 0.7 and near[7] < 0.1


def test_published_fingerprints_subtract_and_peel(spark, make):
    text = "\n".join(f"line {i} of a text" for i in range(300))
    rows = [(9, text), (8, text + "\nline 300 of a text"), (7, "\n".join(text.split("\n")[2:])), (6, ""), (5, "quite another\n" * 3)]
    prints = {r.doc_id: r.fingerprint for r in ps.fingerprints(make(rows)).collect()}
    pairs = [(9, 8), (8, 7), (9, 9), (6, 5), (9, 6)]
    got = spark.createDataFrame([(prints[a], prints[b]) for a, b in pairs], "a string, b string").select(
        "a", "b", ps.difference("a", "b").alias("d")).collect()
    found = {(r.a, r.b): r.d for r in got}
    texts = dict(rows)
    for a, b in pairs[:4]:
        assert found[prints[a], prints[b]] == len(brute_digests(texts[a]) ^ brute_digests(texts[b]))
    assert found[prints[9], prints[6]] is None  # hundreds of digests do not peel from 12 cells


def test_signed_sketch_equals_the_subtracted_sketches_and_takes_fewer_steps(spark):
    row = spark.range(1).select(F.expr("transform(sequence(1, 9), i -> xxhash64(i))").alias("a"),
                                F.expr("transform(sequence(4, 12), i -> xxhash64(i))").alias("b"), F.expr("cast(array() as array<bigint>)").alias("none"))
    for a, b in (("a", "b"), ("b", "a"), ("a", "none"), ("none", "b"), ("a", "a")):
        out = row.select(F.expr(ps.sketch_less(a, b, 8)).alias("x"), F.expr(ps.subtracted(ps.sketch(a, 8), ps.sketch(b, 8))).alias("y")).first()
        assert out.x == out.y
    assert "zip_with" not in ps.part_difference("a", "b") and f"sequence(1, {4 * ps.SLOTS})" in ps.part_difference("a", "b")


def test_peeling_recovers_small_differences(spark):
    row = spark.range(1).select(F.expr("transform(sequence(1, 500), i -> xxhash64(i))").alias("a"),
                                F.expr("transform(sequence(4, 502), i -> xxhash64(i))").alias("b"))
    cells = ps.subtracted(ps.sketch("a", 8), ps.sketch("b", 8))
    assert row.select(F.expr(ps.peeled(cells, 8)).alias("d")).first().d == 5
    full = row.select(F.expr(ps.peeled(ps.sketch("a", 8), 8)).alias("d")).first().d
    assert full is None  # 500 digests do not peel from 24 cells


def test_op4_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = QUERIES["op4_paragraph_sketch"](spark, SF)
    assert sketch_rows(df) == brute_sketch_rows(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# nearest neighbours

def brute_nearest(vectors, k, is_query):
    ok = [(i, np.array(v, np.float64)) for i, v in vectors
          if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if is_query(q):
            rest = sorted(((-float(np.cumsum(x * y)[-1]), i) for i, y in ok if i != q))
            out[q] = [(i, -s) for s, i in rest[:k]]
    return out


def test_all_buckets_probed_is_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    data += [(i, data[7][1]) for i in range(300, 400)] + [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0] * 7 + [float("nan")]),
                                                         (404, [1.0] * 7 + [float("inf")]), (405, [1.0, 2.0]), (406, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in data], "vec_id long, embedding array<float>, rep int, score double, place int")
    rows = cp.nearest(df, F.col("id") % 20 == 0, k=5, tables=2, probes=16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(data, 5, lambda q: q % 20 == 0)
    assert got == want
    assert cp.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block_rows", [64, cp.BLOCK_ROWS])
def test_ties_of_distinct_vectors_go_to_smaller_ids(spark, monkeypatch, block_rows):
    monkeypatch.setattr(cp, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(9)
    ids = rng.permutation(600)
    data = [(int(i), [float(x) for x in rng.integers(0, 2, 8)]) for i in ids]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in cp.nearest(df, F.col("id") % 20 == 0, k=20, tables=1, probes=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(data, 20, lambda q: q % 20 == 0)


def test_ties_of_large_and_missing_ids(spark):
    """Ties of one bucket, with ids beyond what a double holds and without one."""
    big = 1 << 60
    data = [(None if i % 9 == 5 else big + i, [1.0, i / 1024] + [0.0] * 6) for i in range(60, -1, -1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    want = [big + i for i in range(1, 61) if i % 9 != 5]
    for k in (20, 58):
        rows = cp.nearest(df, F.col("id") == big, k=k, tables=1, probes=16).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in rows] == [(i, 1.0) for i in (want + [None] * 7)[:k]]


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")
    rows = cp.nearest(df, F.col("id") % 20 == 0, k=20, tables=1, probes=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == [
        (0, 1, 20, 1.0), (0, 2, 21, 0.5), (20, 1, 0, 1.0), (20, 2, 21, 0.5)]


def test_short_answers_are_completed(spark):
    """Few rows in 64 dimensions, and queries that face away from a crowded bucket."""
    rng = np.random.default_rng(4)
    few = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(0, 300, 20)]
    schema = "vec_id long, embedding array<float>"
    got = {}
    for r in cp.nearest(spark.createDataFrame(few, schema), F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {i: {j for j, _ in few if j != i} for i, _ in few}
    axis = np.eye(64)[0]
    crowd = [(i, [float(np.float32(x)) for x in axis + rng.normal(size=64) / 1000]) for i in range(1, 100)]
    crowd += [(200, (-axis).tolist()), (300, axis.tolist())]
    rows = cp.nearest(spark.createDataFrame(crowd, schema), F.col("id") >= 200, k=20).orderBy("query_id", "rank").collect()
    for q, x in crowd[-2:]:
        want = sorted((-float(np.cumsum(np.array(x) * np.array(y))[-1]), i) for i, y in crowd if i != q)[:20]
        assert [(r.score, r.vec_id) for r in rows if r.query_id == q] == [(-s, i) for s, i in want]


def test_op3_recall(spark):
    sf = "/root/testdata/sf0.01"
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x, ids = np.array([v for _, v in data], np.float64), np.array([i for i, _ in data])
    hits = total = 0
    found_rows = {}
    for r in QUERIES["op3_cross_polytope"](spark, sf).collect():
        found_rows.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 20 == 0):
        dots = x @ x[q]
        dots[q] = -9
        best = set(ids[np.argsort(-dots, kind="stable")[:20]].tolist())
        hits += len(best & found_rows[int(ids[q])])
        total += 20
    assert len(found_rows) == (ids % 20 == 0).sum() and hits / total >= 0.9
