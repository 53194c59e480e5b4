"""Model fits on Spark ML: boosted trees, quantiles by leaf, ordinal logit, calibration, intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.operators.ranks import exact_quantiles
from cohortcast.session import materialize

SEED = 42


@dataclass(frozen=True)
class Trees:
    """Boosting settings (rounds, learning rate, depth, smallest leaf, row sample)."""

    rounds: int = 10
    rate: float = 0.1
    depth: int = 3
    min_rows: int = 8
    sample: float = 0.8

    def params(self) -> dict:
        return {"maxIter": self.rounds, "stepSize": self.rate, "maxDepth": self.depth,
                "minInstancesPerNode": self.min_rows, "subsamplingRate": self.sample, "seed": SEED}


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
                   trees: Trees = Trees(), validation: str | None = None):
    """Boosted made-it classifier; `validation` names a boolean column for early stopping."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", **trees.params())
    if weight:
        gbt.setWeightCol(weight)
    if validation:
        gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assembler(features), gbt]).fit(train)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
                  trees: Trees = Trees()):
    gbt = GBTRegressor(labelCol=label, featuresCol="features", **trees.params())
    if weight:
        gbt.setWeightCol(weight)
    return Pipeline(stages=[assembler(features), gbt]).fit(train)


MODEL_COLUMNS = ("features", "rawPrediction", "probability", "prediction", "leaf")


def probability_of(model, df: DataFrame, out: str, index: int = 1) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[index])
    return scored.drop(*MODEL_COLUMNS)


def prediction_of(model, df: DataFrame, out: str, log_scale: bool = False) -> DataFrame:
    p = F.exp("prediction") if log_scale else F.col("prediction")
    return model.transform(df).withColumn(out, p).drop(*MODEL_COLUMNS)


def importance_table(spark: SparkSession, model, features: Sequence[str], top: int = 15) -> DataFrame:
    """Largest feature importances, ranked (one row per feature: as small as the feature list)."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, values)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows)], "rank INT, feature STRING, importance DOUBLE")


# ── quantiles by leaf ───────────────────────────────────────────────────────


@dataclass
class LeafQuantiles:
    """A fitted tree and a table of exact outcome quantiles per leaf."""

    features: list[str]
    tree: DecisionTreeRegressionModel
    table: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the quantile columns; the table has a row per leaf."""
        leafed = self.tree.transform(assembler(self.features).transform(df)).drop("features", "prediction")
        return leafed.join(self.table, "leaf", "left").drop("leaf")


def fit_leaf_quantiles(train: DataFrame, features: Sequence[str], label: str, taus: Mapping[str, float], depth: int = 3,
                       min_rows: int = 8) -> LeafQuantiles:
    """Quantiles of the outcome among the training rows of a row's leaf, all levels (column -> level) from one tree."""
    data = assembler(features).transform(train.where(F.col(label).isNotNull()))
    return LeafQuantiles(list(features), *leaf_quantiles(data, label, taus, depth, min_rows))


def leaf_quantiles(data: DataFrame, label: str, taus: Mapping[str, float], depth: int = 3,
                   min_rows: int = 8) -> tuple[DecisionTreeRegressionModel, DataFrame]:
    """A tree on the vector `features`, and the quantiles of the label in its leaves."""
    tree = DecisionTreeRegressor(featuresCol="features", labelCol=label, leafCol="leaf", maxDepth=depth,
                                 minInstancesPerNode=min_rows, seed=SEED).fit(data)
    return tree, exact_quantiles(tree.transform(data).select("leaf", label), ["leaf"], label, list(taus.values()), list(taus))


# ── calibration ─────────────────────────────────────────────────────────────


def fit_isotonic(df: DataFrame, p: str, label: str, digits: int | None = None):
    """Monotone map of a probability to the observed rate.

    Equal scores are averaged first. With `digits` scores are rounded to that grid, which bounds the rows of the final
    pooling for very many distinct scores; by default they are taken as they are.
    """
    x = F.col(p) if digits is None else F.round(p, digits)
    grid = df.where(F.col(p).isNotNull()).groupBy(x.alias("x")).agg(
        F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(grid)


def apply_isotonic(model, df: DataFrame, p: str, out: str) -> DataFrame:
    """Linear interpolation between the stored points, constant beyond the ends."""
    own = model.copy().setFeaturesCol("__score").setPredictionCol(out)
    return own.transform(df.withColumn("__score", F.col(p))).drop("__score")


def isotonic_points(spark: SparkSession, model) -> DataFrame:
    return spark.createDataFrame(list(zip(map(float, model.boundaries), map(float, model.predictions))), "x DOUBLE, y DOUBLE")


# ── buckets ─────────────────────────────────────────────────────────────────


def fit_buckets(train: DataFrame, features: Sequence[str], bucket: str, trees: int = 20, depth: int = 4):
    forest = RandomForestClassifier(labelCol=bucket, featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[assembler(features), forest]).fit(train)


def bucket_probabilities(model, df: DataFrame, out: str, levels: int) -> DataFrame:
    """Probability array over all levels; levels above the largest seen in training get 0."""
    p = vector_to_array("probability")
    padded = F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(levels) - F.size(p), F.lit(0))))
    return model.transform(df).withColumn(out, padded).drop(*MODEL_COLUMNS)


@dataclass(frozen=True)
class OrdinalModel:
    """Thresholds and shared slopes of P(bucket > k) = sigmoid(threshold_k + slopes . x)."""

    features: tuple[str, ...]
    thresholds: tuple[float, ...]
    slopes: tuple[float, ...]

    def probabilities(self) -> Column:
        score = F.lit(0.0)
        for f, b in zip(self.features, self.slopes):
            score = score + F.lit(b) * F.col(f)
        above = [F.lit(1.0) / (1 + F.exp(-(F.lit(t) + score))) for t in sorted(self.thresholds, reverse=True)]
        edges = [F.lit(1.0), *above, F.lit(0.0)]
        return F.array(*[edges[i] - edges[i + 1] for i in range(len(edges) - 1)])


def fit_ordinal(train: DataFrame, features: Sequence[str], bucket: str, levels: int, weight: str | None = None,
                reg: float = 0.01, iterations: int = 25) -> OrdinalModel:
    """Proportional odds as one logistic regression on rows stacked once per threshold."""
    steps = levels - 1
    w = F.col(weight) if weight else F.lit(1.0)
    stacked = train.select(*features, bucket, w.alias("__w"), F.explode(F.array(*[F.lit(k) for k in range(steps)])).alias("__k"))
    stacked = stacked.select(
        *[(F.col("__k") == k).cast("double").alias(f"__t{k}") for k in range(steps)], *features, "__w",
        (F.col(bucket) > F.col("__k")).cast("double").alias("__y"))
    names = [f"__t{k}" for k in range(steps)] + list(features)
    lr = LogisticRegression(featuresCol="features", labelCol="__y", weightCol="__w", fitIntercept=False,
                            regParam=reg, maxIter=iterations, standardization=True)
    coef = lr.fit(assembler(names).transform(stacked)).coefficients.toArray()
    return OrdinalModel(tuple(features), tuple(map(float, coef[:steps])), tuple(map(float, coef[steps:])))


def poisson_weight(ids: str, replicate: int) -> Column:
    """Poisson(1) draw that depends only on the row id and the replicate number.

    The steps run until their probabilities fill the resolution of the hash, so no draw is cut off.
    """
    steps = 1 << 52
    u = F.pmod(F.xxhash64(F.col(ids), F.lit(replicate)), F.lit(steps)) / float(steps)
    total, out, k = 0.0, None, 0
    while 1 - total > 1 / steps and k < 20:
        total += math.exp(-1) / math.factorial(k)
        out = F.when(u < total, F.lit(float(k))) if out is None else out.when(u < total, F.lit(float(k)))
        k += 1
    return out.otherwise(F.lit(float(k)))


def fit_bootstrap(train: DataFrame, ids: str, features: Sequence[str], bucket: str, levels: int,
                  replicates: int, **settings) -> list[OrdinalModel]:
    """One ordinal fit per replicate on Poisson-weighted rows, side by side."""
    def fit(r: int) -> OrdinalModel:
        return fit_ordinal(train.withColumn("__b", poisson_weight(ids, r)).where("__b > 0"), features, bucket, levels, "__b", **settings)

    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(fit, range(replicates)))


def intervals(models: Sequence[OrdinalModel], levels: int, lo: float = 0.1, hi: float = 0.9) -> Column:
    """Array with a struct per bucket: mean, lower and upper quantile of the replicate probabilities, row by row.

    The replicates are rows of one array of parameters, and each is worked out once a row; as expressions of their own they would be
    worked out again wherever the mean and the quantiles use them.
    """
    features, steps, n = models[0].features, levels - 1, len(models)
    replicates = F.array(*[F.array(*map(F.lit, (*sorted(m.thresholds, reverse=True), *m.slopes))) for m in models])

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def edges(m: Column) -> Column:
        """Probabilities of more than -1, 0, ... buckets."""
        score = F.lit(0.0)
        for i, f in enumerate(features):
            score = score + F.get(m, F.lit(steps + i)) * F.col(f)
        return once(score, lambda s: F.array(F.lit(1.0), *[F.lit(1.0) / (1 + F.exp(-(F.get(m, F.lit(k)) + s))) for k in range(steps)], F.lit(0.0)))

    def quantile(sorted_: Column, q: float) -> Column:
        h = q * (n - 1)
        i, j = math.floor(h), math.ceil(h)
        return F.get(sorted_, F.lit(i)) + (h - i) * (F.get(sorted_, F.lit(j)) - F.get(sorted_, F.lit(i)))

    def summary(b: Column, values: Column) -> Column:
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
        return F.struct(b.alias("bucket"), mean.alias("p"), quantile(values, lo).alias("p_lo"), quantile(values, hi).alias("p_hi"))

    def per_bucket(found: Column) -> Column:
        return F.transform(F.array(*[F.lit(b) for b in range(levels)]), lambda b: once(
            F.sort_array(F.transform(found, lambda e: F.get(e, b) - F.get(e, b + 1))), lambda values: summary(b, values)))

    return once(F.transform(replicates, edges), per_bucket)


def interval_columns(models: Sequence[OrdinalModel], levels: int, lo: float = 0.1, hi: float = 0.9) -> list[Column]:
    """The structs of `intervals` as columns; whoever needs all of them takes the array, which is worked out once."""
    found = intervals(models, levels, lo, hi)
    return [F.get(found, F.lit(b)) for b in range(levels)]


# ── loops over folds and settings ───────────────────────────────────────────


def cross_validate(data: DataFrame, year: str, folds: Iterable[int], fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
                   threads: int = 1) -> DataFrame:
    """Out-of-sample rows of all folds: fit on earlier years, predict the fold's own year; `threads` folds side by side."""
    def run(k: int) -> DataFrame:
        return fit_predict(data.where(F.col(year) < k), data.where(F.col(year) == k)).withColumn("fold", F.lit(k))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(run, folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibrate_forward(scored: DataFrame, fold: str, folds: Sequence[int], p: str, label: str, out: str) -> DataFrame:
    """Add `out`, the score after an isotonic map learned from the out-of-sample scores of earlier folds only.

    A fold's rows were scored by models that had not seen them, and its map has not seen the fold, so no row takes part in what
    scores or calibrates it. The first fold has no earlier one and keeps its scores.
    """
    scored = materialize(scored, "out-of-sample")
    first, *later = sorted(folds)
    done = scored.where(F.col(fold) == first).withColumn(out, F.col(p))
    with ThreadPoolExecutor(4) as pool:
        maps = list(pool.map(lambda k: fit_isotonic(scored.where(F.col(fold) < k), p, label), later))
    for k, model in zip(later, maps):
        done = done.unionByName(apply_isotonic(model, scored.where(F.col(fold) == k), p, out))
    return done


def tune(data: DataFrame, year: str, cutoffs: Sequence[int], horizon: int, settings: Sequence[Trees],
         score: Callable[[DataFrame, DataFrame, Trees], float]) -> list[tuple[Trees, float, int]]:
    """Mean score of each setting over expanding time folds, and the number of folds used."""
    out = []
    for s in settings:
        values = []
        for c in cutoffs:
            train, test = data.where(F.col(year) <= c), data.where(F.col(year).between(c + 1, c + horizon))
            if not train.isEmpty() and not test.isEmpty():
                values.append(score(train, test, s))
        if values:
            out.append((s, sum(values) / len(values), len(values)))
    return out


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
