"""Training, scoring, calibration and attribution of area risk scores with pyspark.ml."""

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.operators import metrics
from hotgrid.session import cut_lineage, scratch_folder

# columns that identify a row or leak the label
NOT_FEATURES = ("cell_id", "date", "shift", "n_crimes", "has_crime", "split", "year")
NUMERIC = ("float", "double", "tinyint", "smallint", "int", "bigint")
MAX_TRAIN_ROWS = 4_000_000


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that may be used as features."""
    return [name for name, kind in df.dtypes if kind in NUMERIC and name not in NOT_FEATURES]


def cap_training_rows(
    train: DataFrame, max_rows: int = MAX_TRAIN_ROWS, negative_rate: float = S.NEGATIVE_SAMPLE_RATE, seed: int = 42
) -> DataFrame:
    """Rows to fit on: all positives, and a share of the negatives so that at most about ``max_rows`` rows remain.

    At most ``negative_rate`` of the negatives is used, but never fewer than there are positives.
    """
    counts = train.agg(
        F.struct(F.count_if(F.col("has_crime") == 1).alias("pos"), F.count(F.lit(1)).alias("all"))
    ).scalar()
    rows = train.withColumn("_c", counts)
    pos, every = F.col("_c.pos"), F.col("_c.all")
    negatives = F.greatest(every - pos, F.lit(1))
    want = F.greatest(F.least(F.lit(max_rows) - pos, negatives * negative_rate), pos)
    keep_rate = want / negatives
    draw = F.pmod(F.xxhash64("cell_id", "date", "shift", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.where((F.col("has_crime") == 1) | (draw < keep_rate)).drop("_c")


def _plain(name: str) -> str:
    return name.replace(".", "_")


def _with_plain_names(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """pyspark.ml cannot address column names with dots: add dot-free copies."""
    return df.withColumns({_plain(f): F.col(f"`{f}`") for f in features if "." in f})


def train_risk_model(
    matrix: DataFrame, features: Sequence[str] | None = None, kind: str = "gbt", max_iter: int = 500, seed: int = 42
) -> PipelineModel:
    """Classifier of has_crime on the train split; boosted trees grow until the val split gains nothing more."""
    features = list(features or feature_columns(matrix))
    used = cap_training_rows(matrix.where(F.col("split") == "train"), seed=seed).unionByName(
        matrix.where(F.col("split") == "val")
    )
    used = used.select(
        *[F.col(f"`{f}`").alias(_plain(f)) for f in features], "has_crime", (F.col("split") == "val").alias("is_val")
    )
    assembler = VectorAssembler(inputCols=[_plain(f) for f in features], outputCol="features")
    if kind == "gbt":
        learner = GBTClassifier(
            labelCol="has_crime", maxDepth=5, maxIter=max_iter, stepSize=0.1, subsamplingRate=0.8,
            validationIndicatorCol="is_val", seed=seed, minInstancesPerNode=20,
        )
    else:
        used = used.where(~F.col("is_val"))
        learner = LogisticRegression(labelCol="has_crime", maxIter=max_iter, standardization=True)
    return Pipeline(stages=[assembler, learner]).fit(used)


def score(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    """Risk score of every row."""
    dotted = [f for f in feature_columns(matrix) if "." in f]
    out = model.transform(_with_plain_names(matrix, dotted)).withColumn("risk_score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction", *[_plain(f) for f in dotted])


def feature_importance(model: PipelineModel, features: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    """Features by importance; as many entries as features."""
    learner = model.stages[-1]
    values = learner.featureImportances if hasattr(learner, "featureImportances") else learner.coefficients
    pairs = zip(features, (float(abs(v)) for v in values.toArray()))
    return sorted(pairs, key=lambda fv: (-fv[1], fv[0]))[:top]


def isotonic_calibration(scored: DataFrame) -> DataFrame:
    """Test rows with ``risk_calibrated`` from an isotonic fit of the val split; values outside are clipped."""
    data = scored.select("*", F.col("has_crime").cast("double").alias("label"))
    fit = IsotonicRegression(featuresCol="risk_score", labelCol="label", predictionCol="risk_calibrated").fit(
        data.where(F.col("split") == "val").select("risk_score", "label")
    )
    return fit.transform(data.where(F.col("split") == "test")).drop("label")


def calibration_report(calibrated: DataFrame) -> DataFrame:
    """One row: test size, positive rate, Brier score and calibration error before and after."""
    rows = cut_lineage(
        calibrated.select(
            F.xxhash64("cell_id", "date", "shift").alias("id"), "has_crime", "risk_score", "risk_calibrated"
        )
    )
    raw = metrics.reliability_curve(rows, "has_crime", "risk_score")
    cal = metrics.reliability_curve(rows, "has_crime", "risk_calibrated")
    y = F.col("has_crime")
    return rows.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.avg(y), 4).alias("pos_rate"),
        F.round(F.avg(F.pow(F.col("risk_score") - y, 2)), 5).alias("brier_raw"),
        F.round(F.avg(F.pow(F.col("risk_calibrated") - y, 2)), 5).alias("brier_calibrated"),
    ).select(
        "*",
        F.round(metrics.expected_calibration_error(raw), 4).alias("ece_raw"),
        F.round(metrics.expected_calibration_error(cal), 4).alias("ece_calibrated"),
    )


# --- linear scores: exact additive attribution ---------------------------------
def linear_score(matrix: DataFrame, coefficients: Mapping[str, float], intercept: float) -> DataFrame:
    """Logistic score with given coefficients."""
    margin = F.lit(float(intercept))
    for name, value in coefficients.items():
        margin = margin + F.lit(float(value)) * F.col(f"`{name}`")
    return matrix.withColumn("risk_score", 1 / (1 + F.exp(-margin)))


def _means(matrix: DataFrame, coefficients: Mapping[str, float]) -> Column:
    return matrix.agg(F.array(*[F.avg(F.col(f"`{c}`").cast("double")) for c in coefficients])).scalar()


def attributions(scored: DataFrame, coefficients: Mapping[str, float], keep: Sequence[str]) -> DataFrame:
    """Long table (row, feature, value): coef * (x - mean), which adds up to the margin over its mean."""
    rows = scored.withColumn("_m", _means(scored, coefficients))
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                (F.lit(float(value)) * (F.col(f"`{name}`").cast("double") - F.col("_m")[i])).alias("contribution"),
            )
            for i, (name, value) in enumerate(coefficients.items())
        ]
    )
    return rows.select(*keep, F.explode(parts).alias("a")).select(*keep, "a.feature", "a.contribution")


def global_attribution(scored: DataFrame, coefficients: Mapping[str, float], top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature, computed as one aggregate without exploding the rows."""
    rows = scored.withColumn("_m", _means(scored, coefficients))
    sums = [
        F.avg(F.abs(F.lit(float(v)) * (F.col(f"`{c}`").cast("double") - F.col("_m")[i]))).alias(f"_a{i}")
        for i, (c, v) in enumerate(coefficients.items())
    ]
    one = rows.agg(*sums)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"_a{i}").alias("mean_abs")) for i, c in enumerate(coefficients)]
    )
    out = one.select(F.explode(pairs).alias("a")).select("a.*")
    return out.orderBy(F.desc("mean_abs"), "feature").limit(top)


# --- boosted trees: what each split on a row's path adds to its margin -----------
class Tree(NamedTuple):
    """One boosted tree with its weight: per node the feature (-1 in a leaf), threshold, children and mean."""

    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    mean: np.ndarray


def boosted_trees(model: PipelineModel, spark: SparkSession) -> list[Tree]:
    """The trees of a fitted model, from its saved form: a few thousand nodes."""
    learner = model.stages[-1]
    folder = scratch_folder(spark, "trees")
    learner.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    out = []
    for number, weight in enumerate(learner.treeWeights):
        own = [r for r in nodes if r["treeID"] == number]
        inner = [r["leftChild"] >= 0 for r in own]
        out.append(
            Tree(
                float(weight),
                np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(own, inner, strict=True)]),
                np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(own, inner, strict=True)]),
                np.array([r["leftChild"] for r in own]),
                np.array([r["rightChild"] for r in own]),
                np.array([r["prediction"] for r in own]),
            )
        )
    return out


def base_margin(trees: Sequence[Tree]) -> float:
    """The margin before any split is known."""
    return float(sum(t.weight * t.mean[0] for t in trees))


def path_contributions(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """(rows, features): the change of the trees' means at every split on a row's paths, credited to the split's feature."""
    out, rows = np.zeros(x.shape), np.arange(len(x))
    for tree in trees:
        node = np.zeros(len(x), np.int64)
        while True:
            feature = tree.feature[node]
            inner = feature >= 0
            if not inner.any():
                break
            down = np.where(x[rows, feature] <= tree.threshold[node], tree.left[node], tree.right[node])
            following = np.where(inner, down, node)
            out[rows[inner], feature[inner]] += tree.weight * (tree.mean[following] - tree.mean[node])[inner]
            node = following
    return out


def tree_attributions(matrix: DataFrame, trees: Sequence[Tree], features: Sequence[str], name: str = "contributions") -> DataFrame:
    """Adds an array with one contribution per feature; with ``base_margin`` they add up to the fitted model's margin."""

    @F.arrow_udf("array<double>")
    def explain(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(features))
        offsets = pa.array(np.arange(len(x) + 1) * len(features), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(path_contributions(trees, x).ravel()))

    return matrix.withColumn(name, explain(F.array(*[F.col(f"`{f}`").cast("double") for f in features])))


def tree_global_attribution(matrix: DataFrame, trees: Sequence[Tree], features: Sequence[str], top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature of the fitted trees."""
    rows = tree_attributions(matrix.select(*[F.col(f"`{f}`") for f in features]), trees, features)
    one = rows.agg(F.array(*[F.avg(F.abs(F.col("contributions")[i])) for i in range(len(features))]).alias("m"))
    names = F.array(*[F.lit(f) for f in features])
    pairs = one.select(F.explode(F.arrays_zip(names.alias("feature"), F.col("m").alias("mean_abs"))).alias("p")).select("p.*")
    return pairs.toDF("feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature").limit(top)


def feature_title(feature: Column, titles: Mapping[str, str] = S.FEATURE_TITLES) -> Column:
    """Display name: fixed title, else the near-repeat pattern spelled out, else the name itself."""
    entries = [F.lit(x) for kv in titles.items() for x in kv]
    known = F.try_element_at(F.create_map(*entries), feature)
    near = F.concat(
        F.lit("Crimes within "), F.regexp_extract(feature, S.NEAR_FEATURE_PATTERN, 1),
        F.lit(" km, last "), F.regexp_extract(feature, S.NEAR_FEATURE_PATTERN, 2), F.lit(" days"),
    )
    return F.coalesce(known, F.when(feature.rlike(S.NEAR_FEATURE_PATTERN), near), feature)


def explain_top(
    scored: DataFrame, coefficients: Mapping[str, float], keys: Sequence[str], top: int = 50, ups: int = 3, downs: int = 2
) -> DataFrame:
    """Sentences for the highest linear scores: strongest raising and lowering features of each."""
    rows = scored.withColumn("_m", _means(scored, coefficients))
    parts = [
        (F.lit(float(value)) * (F.col(f"`{name}`").cast("double") - F.col("_m")[i])) for i, (name, value) in enumerate(coefficients.items())
    ]
    return _sentences(rows.withColumn("_v", F.array(*parts)), list(coefficients), keys, top, ups, downs)


def explain_top_of_trees(
    scored: DataFrame, trees: Sequence[Tree], features: Sequence[str], keys: Sequence[str], top: int = 50, ups: int = 3, downs: int = 2
) -> DataFrame:
    """Sentences for the highest scores of the fitted trees; contributions are computed for those rows only."""
    best = _best(scored, keys, top)
    return _sentences(tree_attributions(best, trees, features, "_v"), features, keys, top, ups, downs)


def _best(scored: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    return scored.orderBy(F.desc(F.round("risk_score", 12)), *keys).limit(top)


def _sentences(rows: DataFrame, names: Sequence[str], keys: Sequence[str], top: int, ups: int, downs: int) -> DataFrame:
    """Sentences for the highest scores, from contributions ``_v`` in the order of ``names``."""
    best = _best(rows, keys, top)
    parts = F.array(*[F.struct(F.lit(name).alias("f"), F.col("_v")[i].alias("v")) for i, name in enumerate(names)])
    long = best.select(*keys, "risk_score", "has_crime", F.explode(parts).alias("a")).select(
        *keys, "risk_score", "has_crime", F.col("a.f").alias("f"), F.round("a.v", 9).alias("v")
    )
    per_row = Window.partitionBy(*keys)
    long = (
        long.withColumn("up", F.row_number().over(per_row.orderBy(F.desc("v"), "f")))
        .withColumn("down", F.row_number().over(per_row.orderBy("v", "f")))
        .withColumn("title", feature_title(F.col("f")))
    )
    pick = lambda cond, n: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(n, "title")))), lambda x: x["title"]), ", "
    )
    texts = long.groupBy(*keys, "risk_score", "has_crime").agg(
        pick((F.col("v") > 0) & (F.col("up") <= ups), "up").alias("raising"),
        pick((F.col("v") < 0) & (F.col("down") <= downs), "down").alias("lowering"),
    )
    # fixed value: explanation sentence
    text = F.concat(
        F.format_string("Risk score: %.3f. ", F.col("risk_score")),
        F.when(F.col("raising") != "", F.concat(F.lit("Risk elevated due to: "), F.col("raising"))).otherwise(
            "No strong risk drivers"
        ),
        F.when(F.col("lowering") != "", F.concat(F.lit(". Mitigating: "), F.col("lowering"))).otherwise(""),
    )
    return texts.select(*keys, "risk_score", "has_crime", text.alias("explanation"))
