"""Word vectors trained part by part against plain versions."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.operators import parted, word2vec as W


def tree(counts):
    batch = pa.RecordBatch.from_pydict({"word": [f"w{k}" for k in range(len(counts))], "n": pa.array(counts, pa.int64())})
    return {w: e for b in W.coded(iter([batch])) for w, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}


@pytest.mark.parametrize("counts", [[9], [7, 5], [40, 30, 9, 9, 5, 5, 5], sorted((int(1e5 / k) + 5 for k in range(1, 400)), reverse=True)])
def test_codes_are_a_shortest_prefix_code(counts):
    codes = tree(counts)
    assert [codes[f"w{k}"][0] for k in range(len(counts))] == list(range(len(counts)))
    paths = {w: e[:0:-1] for w, e in codes.items()}  # from the root
    root = 2 * (len(counts) - 2)
    assert all(p[0] // 2 * 2 == root for p in paths.values() if p)
    heap = list(counts)
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        heapq.heappush(heap, two := heapq.heappop(heap) + heapq.heappop(heap))
        best += two
    assert sum(n * len(paths[f"w{k}"]) for k, n in enumerate(counts)) == best
    bits = {w: "".join(str(x & 1) for x in p) for w, p in paths.items()}
    ordered = sorted(bits.values())
    assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))


def test_one_step_equals_the_sum_over_its_pairs():
    counts = [30, 20, 10, 9, 8, 7, 5]
    codes = tree(counts)
    part = W.Part(pa.array(list(codes)), pa.array(list(codes.values()), pa.list_(pa.int32())), 5, 3, 100.0)
    rng = np.random.default_rng(2)
    part.word_vectors[:-1] = rng.normal(size=(7, 5))
    part.node_vectors[:-1] = rng.normal(size=(6, 5))
    words, nodes = part.word_vectors.astype(float), part.node_vectors.astype(float)
    of, context = np.array([0, 6, 3, 6]), np.array([[1, 1], [2, 7], [7, 7], [5, 0]])
    nodes[0], part.node_vectors[0] = 9 * nodes[0], 9 * part.node_vectors[0]  # margins beyond 6 change nothing
    want_words, want_nodes, far = words.copy(), nodes.copy(), 0
    part._step(of, context.astype(np.int32), context < 7, np.float32(0.1))
    for w, row in zip(of, context):
        for c in row[row < 7]:
            for x in codes[f"w{w}"][1:]:
                if abs(words[c] @ nodes[x >> 1]) >= W.MAX_MARGIN:
                    far += 1
                    continue
                g = 0.1 * (1 - (x & 1) - 1 / (1 + np.exp(-words[c] @ nodes[x >> 1])))
                want_words[c] += g * nodes[x >> 1]
                want_nodes[x >> 1] += g * words[c]
    assert far and part.word_vectors == pytest.approx(want_words, abs=1e-5) and part.node_vectors == pytest.approx(want_nodes, abs=1e-5)
    assert part.moved.tolist() == [True, True, True, False, False, True, False, False]


def test_vectors_are_a_table_and_words_met_together_lie_together(spark):
    from reviewlens.plans import textml
    rnd = random.Random(1)
    rows = [([f"{g}{rnd.randint(0, 9)}" for _ in range(30)],) for g in "ab" for _ in range(600)] + [(["rare", "a1"],), ([],), (None,), (["rare"],)]
    df = spark.createDataFrame(rows, "toks array<string>").repartition(4)
    model = textml.word2vec("toks", "v", num_partitions=2, vector_size=10).fit(df)
    assert model.getVectors().dtypes == [("word", "string"), ("vector", "array<float>")]
    vectors = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    assert set(vectors) == {f"{g}{k}" for g in "ab" for k in range(10)}
    unit = {w: v / np.linalg.norm(v) for w, v in vectors.items()}
    same = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] == b[0]]
    other = [unit[a] @ unit[b] for a in unit for b in unit if a[0] != b[0]]
    assert np.mean(same) > np.mean(other) + 0.5
    out = model.transform(df)
    assert out.columns == ["toks", "v"] and out.schema["v"].metadata == {"ml_attr": {"num_attrs": 10}}
    got = [(r.toks, r.v.toArray()) for r in out.collect()]
    assert len(got) == len(rows)
    for toks, v in got:  # words that were left out count, as in the library
        known = [vectors[t] for t in toks or [] if t in vectors]
        assert v == pytest.approx(sum(known) / len(toks) if known else np.zeros(10), abs=1e-5)
    with pytest.raises(ValueError, match="vocabulary size should be > 0"):
        textml.word2vec("toks", "v").fit(df.limit(0))


def test_means_leave_out_partitions_that_did_not_move_a_word():
    rows = [("a", False, [9.0]), ("a", True, [1.0]), ("a", True, [2.0]), ("b", False, [4.0]), ("b", False, [4.0]), ("c", True, [7.0])]
    whole = pa.RecordBatch.from_pydict({"word": [r[0] for r in rows], "moved": [r[1] for r in rows], "vector": pa.array([r[2] for r in rows], pa.list_(pa.float32()))})
    for step in (1, 2, 6):
        cut = [whole.slice(k, step) for k in range(0, 6, step)]
        out = [(w, v) for b in W.averaged(iter(cut), 1) for w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert out == [("a", [1.5]), ("b", [4.0]), ("c", [7.0])]
    assert list(W.averaged(iter([]), 1)) == []
    found, ends = parted.places(pa.array(["x", "y"]), pa.array([["y", None, "z"], None, ["x"]]))
    assert found.tolist() == [1, -1, -1, 0] and ends.tolist() == [3, 3, 4]
