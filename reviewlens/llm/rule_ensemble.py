"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``STATISTICS``: column expressions over the whole text, nothing sampled.
2. A small forest of shallow trees is fitted on the training statistics; every
   path from a root to a node becomes a rule, a conjunction of comparisons.
3. Lasso logistic regression over the rules' 0/1 values keeps few of them.
4. The kept rules are compiled into one column expression,
   ``1 / (1 + exp(-(bias + sum(weight where rule))))``, which scores every row in a
   narrow pass without Python.

Fitted on at most ``max_rows`` labelled rows (see ``common.labelled_sample``).
A null text counts as empty; its statistics are 0, so it gets a score like any
other. Training rows of one class, or none: every score is the share of label 1
(0.5 without rows). Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import fields_of, id_fold, labelled_sample, stored, whole_row

MAX_TRAIN_ROWS = 20_000
FOREST = {"numTrees": 12, "maxDepth": 3, "maxBins": 64, "seed": 17, "featureSubsetStrategy": "onethird",
          "minInstancesPerNode": 5}
LASSO = {"regParam": 0.002, "elasticNetParam": 1.0, "maxIter": 100, "standardization": False}

WORDS = "quality_words"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a non-null text column; needs the word array in column ``WORDS``."""
    chars, words = F.length(text), F.col(WORDS)
    n_words = F.size(words)

    def without(drop: str) -> Column:
        return F.length(F.translate(text, drop, ""))

    pairs = F.zip_with(F.slice(words, F.lit(2), F.greatest(n_words - 1, F.lit(0))), words, lambda a, b: a == b)
    return {
        "log_chars": F.log1p(chars),
        "bang_share": _share(chars - without("!"), chars),
        "bar_share": _share(chars - without("|"), chars),
        "symbol_share": _share(chars - without("#$%&*+=<>^~_{}[]\\/@"), chars),
        "digit_share": _share(chars - without("0123456789"), chars),
        "stop_share": _share(chars - without(".,;:?"), chars),
        "upper_share": _share(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), chars),
        "word_chars": _share(chars, n_words),
        "distinct_share": _share(F.size(F.array_distinct(words)), n_words),
        "echo_share": _share(F.size(F.filter(pairs, lambda same: same)), n_words),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with one column ``stat_<name>`` for each statistic."""
    value = F.coalesce(F.col(text), F.lit(""))
    made = statistics(value)
    out = docs.withColumn(WORDS, F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    out = out.withColumns({f"stat_{name}": expr.cast("double") for name, expr in made.items()}).drop(WORDS)
    return out, [f"stat_{name}" for name in made]


@dataclass(frozen=True)
class Rule:
    """A conjunction: (column, lower bound or None, upper bound or None) - ``lower < x <= upper``."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out = out & (F.col(name) > low)
            if high is not None:
                out = out & (F.col(name) <= high)
        return out


_NODE = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def paths(description: str, names: list[str]) -> list[Rule]:
    """Rules of all paths in a forest's printed trees (each line one comparison)."""
    found: dict[Rule, None] = {}
    open_nodes: list[tuple[int, tuple[int, str, float]]] = []
    for line in description.splitlines():
        m = _NODE.match(line)
        if not m:
            if line.lstrip().startswith("Tree"):
                open_nodes = []
            continue
        depth = len(m[1])
        open_nodes = [x for x in open_nodes if x[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
        bounds: dict[int, list[float | None]] = {}
        for _, (feature, sign, value) in open_nodes:
            own = bounds.setdefault(feature, [None, None])
            if sign == "<=":
                own[1] = value if own[1] is None else min(own[1], value)
            else:
                own[0] = value if own[0] is None else max(own[0], value)
        found[Rule(tuple((names[f], low, high) for f, (low, high) in sorted(bounds.items())))] = None
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 over the statistics columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def constant(share: float) -> RuleModel:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return RuleModel(math.log(share / (1 - share)), ())


def fit(rows: DataFrame, names: list[str]) -> RuleModel:
    """Model of ``rows`` (statistics columns ``names`` and 0/1 column ``y``); rows are read several times."""
    n, ones = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or ones in (0, n):
        return constant(ones / n if n else 0.5)
    vector = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", "y")
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", **FOREST).fit(vector)
    rules = paths(forest.toDebugString, names)
    if not rules:
        return constant(ones / n)
    hits = rows.select("y", *[rule.column().cast("double").alias(f"r{i}") for i, rule in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(hits).select("x", "y")
    lasso = LogisticRegression(featuresCol="x", labelCol="y", **LASSO).fit(hits)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights) if w != 0.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2,
          max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Model from the labelled rows outside fold ``held_out``."""
    sample = labelled_sample(docs, labels, label, lambda i: id_fold(i, folds) != held_out, max_rows)
    rows, names = with_statistics(sample)
    rows = stored(docs.sparkSession, rows.select("y", *names), "quality-training")
    return fit(rows, names)


def _apart(docs: DataFrame) -> DataFrame:
    """``record`` (the row) and ``text``: the statistics' names stand beside the row's own, not among them."""
    return docs.select(whole_row(docs), F.col("text"))


def scored(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (these names are replaced if present)."""
    rows, _ = with_statistics(_apart(docs))
    own = fields_of([name for name in docs.columns if name not in ("score", "predicted")])
    return (rows.withColumn("score", model.score())
            .select(*own, "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` that reach the threshold, with their columns as they were.

    Rejected rows vanish in an explode of an empty array: a filter would be
    pushed below the projection and compute each statistic anew in every rule."""
    rows, _ = with_statistics(_apart(docs))
    none = F.array().cast("array<boolean>")
    keep = F.explode(F.when(model.score() >= threshold, F.array(F.lit(True))).otherwise(none))
    return rows.select("record", keep.alias("accepted_row")).select(*fields_of(docs.columns))
