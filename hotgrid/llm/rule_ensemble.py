"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics (after Friedman and Popescu 2008).

Shallow random trees are grown on a bounded sample of labelled documents; every path from a root is a rule, a conjunction
of bounds on statistics. Lasso logistic regression weighs the rules and drops most of them. What is left is compiled into
one column expression, so that scoring is a projection.

Without labels the score is 0.5, with labels of one class only it is the smoothed share of that class; a null or wordless
text has all statistics 0 and is scored like any other.
"""

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm import stats
from hotgrid.llm.links import fresh, stage

MAX_FIT_ROWS = 20_000
TREES, DEPTH = 24, 3
LASSO = 0.002
MIN_WEIGHT = 1e-3
SEED = 11

Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, at most) of each bound; all must hold

_NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str) -> set[Rule]:
    """Every path from the root of a printed tree, with its bounds joined per statistic."""
    out: set[Rule] = set()
    stack: list[tuple[int, int, str, float]] = []
    for line in tree.splitlines():
        m = _NODE.match(line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, int(m[2]), m[3], float(m[4])))
        bounds: dict[int, tuple[float, float]] = {}
        for _, feature, op, at in stack:
            low, high = bounds.get(feature, (float("-inf"), float("inf")))
            bounds[feature] = (low, min(high, at)) if op == "<=" else (max(low, at), high)
        out.add(tuple((f, *b) for f, b in sorted(bounds.items())))
    return out


def rule_column(rule: Rule, prefix: str = "") -> Column:
    """1 where all bounds of the rule hold, else 0; ``prefix`` names the struct that holds the statistics."""
    test = F.lit(True)
    for feature, low, high in rule:
        value = F.col(prefix + stats.RATIOS[feature])
        if low != float("-inf"):
            test = test & (value > low)
        if high != float("inf"):
            test = test & (value <= high)
    return test.cast("double")


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, struct: str) -> Column:
        """Probability of label 1, over a struct column with the fields ``stats.RATIOS``."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + rule_column(rule, f"{struct}.") * F.lit(weight)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Ensemble:
    """Rules and weights from at most about ``max_rows`` labelled documents."""
    sample = stats.labelled_sample(docs, labels, "quality", max_rows)
    rows = stage(sample.select("label", *stats.ratio_columns(F.col("counts"))), "labelled")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        # one class, or none: the odds of its smoothed share
        good, bad = counts.get(1, 0) + 1, counts.get(0, 0) + 1
        return Ensemble(float(math.log(good / bad)), ())
    features = VectorAssembler(inputCols=list(stats.RATIOS), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED
    ).fit(features)
    found = sorted(set().union(*[paths(t.toDebugString) for t in forest.trees]))
    if not found:
        return Ensemble(float(math.log(counts[1] / counts[0])), ())
    names = [f"r{i}" for i in range(len(found))]
    held = rows.select("label", *[rule_column(r).alias(n) for r, n in zip(found, names, strict=True)])
    held = VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "features")
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(held)
    weights = [(r, float(w)) for r, w in zip(found, lasso.coefficients.toArray(), strict=True) if abs(w) >= MIN_WEIGHT]
    return Ensemble(float(lasso.intercept), tuple(weights))


def scored(docs: DataFrame, model: Ensemble, score: str) -> DataFrame:
    """``docs`` with a double column ``score``."""
    counts, ratios = fresh(docs, "counts"), fresh(docs, "ratios")
    held = docs.withColumn(counts, stats.counted(F.col("text")))
    held = held.withColumn(ratios, F.struct(*stats.ratio_columns(F.col(counts))))
    return held.withColumn(score, model.score(ratios)).drop(counts, ratios)
