"""Quality rules and toxicity: held-out accuracy, folding, odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import rule_ensemble as re_, toxicity as tx
from reviewlens.llm.common import id_fold, labelled_sample
from reviewlens.llm.queries import QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held_out_accuracy(spark, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0.0 <= r.score <= 1.0 for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in judged) / len(judged), rows


def test_op6_query(spark):
    accuracy, rows = held_out_accuracy(spark, "op6_quality_rules", "quality")
    assert accuracy >= 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_op2_query(spark):
    accuracy, rows = held_out_accuracy(spark, "op2_toxic_lexicon", "toxic")
    assert accuracy >= 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_id_fold_is_crc32_of_the_decimal_id(spark):
    import zlib
    rows = spark.range(50).select("id", id_fold(F.col("id"), 5).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert spark.sql("select cast(null as bigint) as id").select(id_fold(F.col("id"), 5)).first()[0] == 0


def test_sample_is_bounded_and_merges_labels(spark, make):
    docs = make([(i, f"text {i}") for i in range(2000)])
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(2000)] + [(0, 1, 0), (None, 1, 1), (1, None, 0)])
    everything = labelled_sample(docs, labels, "quality", lambda i: F.lit(True), 10_000)
    assert everything.count() == 2000 and everything.filter("doc_id = 0").first().y == 1
    assert 200 < labelled_sample(docs, labels, "quality", lambda i: F.lit(True), 400).count() < 600


def test_rules_are_the_paths_of_the_trees():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    found = {rule.bounds for rule in re_.paths(text, ["a", "b"])}
    assert found == {(("a", None, 0.5),), (("a", None, 0.5), ("b", None, 2.0)), (("a", None, 0.5), ("b", 2.0, None)),
                     (("a", 0.5, None),)}


def brute_score(model, stats):
    total = model.bias
    for rule, weight in model.rules:
        if all((low is None or stats[n] > low) and (high is None or stats[n] <= high) for n, low, high in rule.bounds):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_compiled_rules_score_like_the_rules(spark, make):
    good = [(i, f"Plain words number {i} in a calm row of text, nothing odd.") for i in range(0, 120)]
    bad = [(i, "BUY!! NOW!! " * (i % 7 + 1)) for i in range(120, 240)]
    docs = make(good + bad + ODD[:4])
    labels = labels_of(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad])
    model = re_.train(docs, labels)
    assert model.rules
    rows, names = re_.with_statistics(docs)
    stats = {(r.doc_id, r.text): {n: r[n] for n in names} for r in rows.collect()}
    scored = re_.scored(docs, model).collect()
    assert len(scored) == len(good + bad) + 4
    for r in scored:
        assert r.score == pytest.approx(brute_score(model, stats[(r.doc_id, r.text)]), abs=1e-12)
    assert {r.doc_id for r in scored if r.predicted} >= {i for i, _ in good}
    assert not {r.doc_id for r in scored if r.predicted} & {i for i, _ in bad}
    kept = re_.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in good}


def test_statistics_of_odd_texts(spark, make):
    rows, names = re_.with_statistics(make(ODD))
    for r in rows.collect():
        assert all(r[n] is not None and math.isfinite(r[n]) for n in names)
    empty = rows.filter("text is null or text = ''").collect()
    assert len(empty) == 2 and all(r[n] == 0.0 for r in empty for n in names)


@pytest.mark.parametrize("rows,score", [([], 0.5), ([(1, 1, 1), (2, 1, 1), (5, 1, 1)], 1.0), ([(1, 0, 0), (2, 0, 0), (5, 0, 0)], 0.0)])
def test_quality_without_two_classes(spark, make, rows, score):
    docs = make(ODD)
    got = re_.scored(docs, re_.train(docs, labels_of(spark, rows))).collect()
    assert len(got) == len(ODD) and all(abs(r.score - score) < 1e-3 for r in got)


def test_folding():
    assert tx.fold("1D10T  ĺоser, Ｔrаѕh! t​rash @ss") == ["idiot", "loser", "trash", "trash", "ass"]
    assert tx.fold("") == [] and tx.fold(" \n") == []


def test_density_counts_heaviest_entry_once_and_honours_exceptions():
    model = tx.ToxicModel({" trash ": 3.0, " tras": 2.0, " idio": 1.0}, (" trash can ",), 1.0, 0.0)
    machine = model.automaton()
    assert tx.density("the trash idiots".split(), machine) == pytest.approx(math.log1p(100 * 4.0 / 3))
    assert tx.density("the trash can is full".split(), machine) == 0.0
    assert tx.density(["trash", "trash"], machine) == pytest.approx(math.log1p(300.0))
    assert tx.density([], machine) == 0.0
    assert tx.density(["x"], tx.ToxicModel({}, (), 0.0, 0.0).automaton()) == 0.0


def toxic_corpus(spark, make):
    docs = [(i, f"calm words {i} about the garden and w{i % 9}") for i in range(200)]
    docs += [(i, f"calm words {i} you {'m0r0n' if i % 2 else 'moron'} in the garden") for i in range(200, 260)]
    docs += [(i, f"calm words {i} moron prize of the garden") for i in range(260, 268)]
    labels = labels_of(spark, [(i, 1, int(200 <= i < 260)) for i, _ in docs])
    return make(docs + ODD), labels


def test_lexicon_and_exceptions_are_learned(spark, make):
    docs, labels = toxic_corpus(spark, make)
    model = tx.train(docs, labels)
    assert any("moro" in e for e in model.weights)
    assert " moron prize " in model.exceptions
    rows = tx.scores(docs, model).collect()
    assert len(rows) == 268 + len(ODD)
    toxic = {r.doc_id for r in rows if r.score >= 0.5}
    assert toxic == set(range(200, 260))
    kept = tx.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 208 + len(ODD)


@pytest.mark.parametrize("rows,score", [([], 0.0), ([(1, 1, 0), (2, 1, 0)], 0.0), ([(1, 1, 1), (2, 1, 1)], 1.0)])
def test_toxicity_without_two_classes(spark, make, rows, score):
    docs = make(ODD)
    got = tx.scores(docs, tx.train(docs, labels_of(spark, rows))).collect()
    assert len(got) == len(ODD) and all(abs(r.score - score) < 1e-3 for r in got)
    empty = make([])
    assert tx.scores(empty, tx.train(empty, labels_of(spark, []))).count() == 0
