"""Learned recipe as an ML stage, and bundles of fitted models that are saved and loaded as one."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressor, IsotonicRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.operators import models as md
from cohortcast.operators.recipe import learn_medians, near_zero_variance, zero_fill
from cohortcast.session import materialize


class _RecipeParams(Params):
    features = Param(Params._dummy(), "features", "numeric input columns", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "JSON: coverage flag -> features that are 0 where it is 0", TypeConverters.toString)


class Recipe(Estimator, _RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Zero fill, medians and near-constant columns, learned from the rows it is fitted on.

    A feature without any value among them takes 0 and is dropped with the near-constant ones. All parameters are as small as the feature list.
    """

    def __init__(self, features: Sequence[str] = (), fills: Mapping[str, Sequence[str]] | None = None):
        super().__init__()
        self._set(features=list(features), fills=json.dumps({k: list(v) for k, v in (fills or {}).items()}))

    def _fit(self, dataset: DataFrame) -> RecipeModel:
        names = self.getOrDefault("features")
        filled = zero_fill(dataset, json.loads(self.getOrDefault("fills")))
        medians = {r["feature"]: r["med"] for r in learn_medians(filled, names).collect()}
        constant = {r["feature"] for r in near_zero_variance(filled, names).where("near_zero").collect()}
        model = RecipeModel()
        model._set(features=names, fills=self.getOrDefault("fills"), medians=[float(medians.get(f) or 0.0) for f in names],
                   kept=[f for f in names if f in medians and f not in constant])
        return model


class RecipeModel(Model, _RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "learned median of every feature", TypeConverters.toListFloat)
    kept = Param(Params._dummy(), "kept", "features that go into the vector", TypeConverters.toListString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Imputed features, and the kept ones as the vector `features`."""
        names = self.getOrDefault("features")
        filled = zero_fill(dataset, json.loads(self.getOrDefault("fills")))
        return VectorAssembler(inputCols=self.getOrDefault("kept"), outputCol="features").transform(
            filled.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(names, self.getOrDefault("medians"))}))


@dataclass(frozen=True)
class BundleSpec:
    """What a bundle learns: columns of the training rows, and settings."""
    features: tuple[str, ...]
    fills: Mapping[str, Sequence[str]]
    year: str
    label: str
    value: str  # log outcome of the rows with label 1
    bucket: str
    levels: int
    quantiles: Mapping[str, float]
    trees: md.Trees = md.Trees()
    forest: int = 20
    least_rows: int = 40  # fewer rows make no bundle


@dataclass
class Bundle:
    recipe: RecipeModel
    classifier: GBTClassificationModel
    calibrator: IsotonicRegressionModel
    regressor: PipelineModel
    buckets: PipelineModel | None
    tree: DecisionTreeRegressionModel
    table: DataFrame  # quantiles per leaf
    levels: int
    quantiles: list[str]

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.recipe.getOrDefault("features") if c not in df.columns]
        if missing:
            raise ValueError(f"rows lack the features {missing}")

    def score(self, df: DataFrame) -> DataFrame:
        """Add p_raw, p_made_it (calibrated), value, the quantile columns and `probs`, the array over buckets (null without bucket cuts)."""
        self.check(df)
        x = self.recipe.transform(df)
        x = self.classifier.transform(x).withColumn("p_raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        x = md.apply_isotonic(self.calibrator, x, "p_raw", "p_made_it")
        x = self.regressor.transform(x).withColumn("value", F.exp("prediction")).drop("prediction")
        x = self.tree.transform(x).drop("prediction").join(self.table, "leaf", "left").drop("leaf")
        if self.buckets is None:
            return x.withColumn("probs", F.lit(None).cast("array<double>")).drop("features")
        return md.bucket_probabilities(self.buckets, x, "probs", self.levels)

    def save(self, path: str) -> None:
        stages = {"recipe": self.recipe, "classifier": self.classifier, "calibrator": self.calibrator, "regressor": self.regressor,
                  "tree": self.tree, **({"buckets": self.buckets} if self.buckets else {})}
        for name, stage in stages.items():
            stage.write().overwrite().save(f"{path}/{name}")
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        meta = [(self.levels, self.quantiles, self.buckets is not None)]
        self.table.sparkSession.createDataFrame(meta, "levels INT, quantiles ARRAY<STRING>, has_buckets BOOLEAN").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        meta = spark.read.schema("levels INT, quantiles ARRAY<STRING>, has_buckets BOOLEAN").json(f"{path}/meta").first()
        return Bundle(RecipeModel.load(f"{path}/recipe"), GBTClassificationModel.load(f"{path}/classifier"),
                      IsotonicRegressionModel.load(f"{path}/calibrator"), PipelineModel.load(f"{path}/regressor"),
                      PipelineModel.load(f"{path}/buckets") if meta["has_buckets"] else None, DecisionTreeRegressionModel.load(f"{path}/tree"),
                      spark.read.parquet(f"{path}/table"), meta["levels"], list(meta["quantiles"]))


def time_cuts(per_year: Mapping[int, int], share: float = 0.25) -> tuple[int, int]:
    """First year of the rows that stop the fit early, and of those that calibrate: the two latest quarters of the rows, a year at least each."""
    years = sorted(per_year)
    if len(years) < 2:
        raise ValueError("a calibrated fit needs rows of two years at least")
    total, late, cuts = sum(per_year.values()), 0, []
    for y in reversed(years):
        late += per_year[y]
        if late >= share * total * (len(cuts) + 1) and len(cuts) < 2:
            cuts.append(y)
    if cuts[0] == years[0]:  # nearly all rows are of the first year: the others calibrate
        return years[0], years[1]
    return cuts[-1], cuts[0]


def fit_bundle(train: DataFrame, spec: BundleSpec, per_year: Mapping[int, int]) -> Bundle:
    """Fit all models of a bundle on one written table.

    The classifier is fitted twice: on the earlier years, stopped early on the next ones, to score the latest years, which the
    calibrator learns from; and on all rows with the number of rounds found. So no calibration row was seen by the model that scored it.
    """
    stop, calibrate = time_cuts(per_year)
    year = F.col(spec.year)
    inner = Recipe(spec.features, spec.fills).fit(train.where(year < calibrate))
    gbt = GBTClassifier(labelCol=spec.label, featuresCol="features", **spec.trees.params())
    early = inner.transform(train.where(year < calibrate)).withColumn("__late", year >= stop)
    if min(per_year) < stop < calibrate:
        early_model = gbt.copy().setValidationIndicatorCol("__late").fit(early)
    else:
        early_model = gbt.fit(early)
    late = early_model.transform(inner.transform(train.where(year >= calibrate)))
    calibrator = md.fit_isotonic(late.withColumn("__p", vector_to_array("probability")[1]), "__p", spec.label)

    recipe = Recipe(spec.features, spec.fills).fit(train)
    x = recipe.transform(train)
    classifier = gbt.setMaxIter(early_model.getNumTrees).fit(x)
    hits = x.where((F.col(spec.label) == 1) & F.col(spec.value).isNotNull())
    regressor = PipelineModel([GBTRegressor(labelCol=spec.value, featuresCol="features", **spec.trees.params()).fit(hits)])
    cut = x.where(F.col(spec.bucket).isNotNull())
    forest = RandomForestClassifier(labelCol=spec.bucket, featuresCol="features", numTrees=spec.forest, maxDepth=4, seed=md.SEED)
    buckets = None if cut.isEmpty() else PipelineModel([forest.fit(cut)])
    tree, table = md.leaf_quantiles(hits, spec.value, spec.quantiles)
    return Bundle(recipe, classifier, calibrator, regressor, buckets, tree, materialize(table, "leaf-table"), spec.levels, list(spec.quantiles))


REST = "__rest"


def fit_bundles(train: DataFrame, by: str, spec: BundleSpec, threads: int = 8) -> dict[str, Bundle]:
    """A bundle per value of `by`, side by side; values with too few rows, with one class or one year only share the bundle `REST` of all rows.

    One row per value and year reaches the driver.
    """
    hit = F.col(spec.label)
    counts = train.groupBy(by, spec.year).agg(F.count("*").alias("n"), F.sum(hit).alias("hits")).collect()
    groups: dict[str, dict[int, int]] = {}
    hits: dict[str, int] = {}
    for r in counts:
        for key in {r[by], REST} - {None}:
            per_year = groups.setdefault(key, {})
            per_year[r[spec.year]] = per_year.get(r[spec.year], 0) + r["n"]
            hits[key] = hits.get(key, 0) + (r["hits"] or 0)
    enough = [k for k, n in groups.items() if k == REST or (sum(n.values()) >= spec.least_rows and len(n) > 1 and spec.least_rows / 4 <= hits[k] < sum(n.values()))]
    own = [k for k in enough if k != REST]
    needed = own if {r[by] for r in counts} <= set(own) else enough

    def fit(key: str) -> Bundle:
        return fit_bundle(train if key == REST else train.where(F.col(by) == key), spec, groups[key])

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(needed, pool.map(fit, needed)))


def score_bundles(df: DataFrame, by: str, bundles: Mapping[str, Bundle]) -> DataFrame:
    """Every row scored by the bundle of its value, others and nulls by `REST`; `bundle` names it. Without `REST` such rows are an error."""
    own = [k for k in bundles if k != REST]
    parts = [bundles[k].score(df.where(F.col(by) == k)).withColumn("bundle", F.lit(k)) for k in own]
    others = df.where(F.col(by).isNull() | ~F.col(by).isin(own)) if own else df
    if REST in bundles:
        parts.append(bundles[REST].score(others).withColumn("bundle", F.lit(REST)))
    elif not others.isEmpty():
        raise ValueError(f"no bundle for some values of {by}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save_bundles(bundles: Mapping[str, Bundle], path: str, threads: int = 8) -> list[str]:
    """Folders `<path>/<number>`, in the order of the returned names; written side by side, as a bundle is some twenty small jobs."""
    names = sorted(bundles)
    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(lambda i: bundles[names[i]].save(f"{path}/{i}"), range(len(names))))
    return names


def load_bundles(spark: SparkSession, path: str, names: Sequence[str], threads: int = 8) -> dict[str, Bundle]:
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(names, pool.map(lambda i: Bundle.load(spark, f"{path}/{i}"), range(len(names)))))
