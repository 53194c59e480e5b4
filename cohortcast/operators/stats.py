"""Fitted statistics: robust scales, strictly-past covariances, calibration lines, value scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators.grouped import attach
from cohortcast.operators.ranks import cume_dist_in_group, exact_quantiles, prefix_counts
from cohortcast.session import materialize


def standardize_with(df: DataFrame, train: DataFrame, values: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Scale by the mean and spread of a training set (scalar subqueries, merged into one pass)."""
    return df.withColumns({
        v + suffix: F.try_divide(F.col(v) - train.agg(F.avg(v)).scalar(), train.agg(F.stddev_samp(v)).scalar())
        for v in values})


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value) rows of the non-null features."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keys), list(features), "feature", "value").where(F.col("value").isNotNull())


def robust_scale(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median and scaled median absolute deviation per (keys, feature); 1 for a zero deviation."""
    by = [*keys, "feature"]
    counts = long_features(df, keys, features).groupBy(*by, "value").agg(F.count("*").alias("w"))
    return scale_of_counts(counts, by)


def scale_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same from counted values (columns `value`, `w`)."""
    med = exact_quantiles(counts, by, "value", [0.5], ["med"], weight="w")
    dev = attach(counts, med, by).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    mad = exact_quantiles(dev, by, "dev", [0.5], ["mad"], weight="w")
    scale = F.col("mad") * presets.MAD_FACTOR
    return attach(med, mad, by).select(*by, "med", F.when(scale > 0, scale).otherwise(1.0).alias("scale"))


def cohort_years(df: DataFrame, year: str) -> Column:
    """The distinct cohort years in order, as an array that the plan itself works out: one number per cohort, however many there are."""
    return df.where(F.col(year).isNotNull()).agg(F.array_sort(F.collect_set(year))).scalar()


def for_cohorts(df: DataFrame, year: str, cohorts: Column, strict: bool = True) -> DataFrame:
    """Copy each row to the cohorts (an array column) it may inform: later ones, or all of them."""
    each = df.withColumn("__cohorts", cohorts)  # a subquery may not stand inside the filter itself
    chosen = F.filter("__cohorts", lambda c: c > F.col(year)) if strict else F.col("__cohorts")
    return each.withColumn("cohort", F.explode(chosen)).drop("__cohorts")


def past_scale(pool: DataFrame, cohorts: Column, keys: Sequence[str], year: str, features: Sequence[str],
               strict: bool = True) -> DataFrame:
    """Robust scale per (keys, cohort, feature) from pool rows of earlier years only.

    Values are counted per year before they are copied to the later cohorts, and there are as many
    copies as cohort years, not as pairs of rows. With `strict` off every year takes part.
    """
    per_year = long_features(pool, [*keys, year], features).groupBy(*keys, year, "feature", "value").agg(
        F.count("*").alias("w"))
    spread = for_cohorts(per_year, year, cohorts, strict)
    by = [*keys, "cohort", "feature"]
    counts = spread.groupBy(*by, "value").agg(F.sum("w").alias("w"))
    return scale_of_counts(counts, by)


def past_covariance(pool: DataFrame, keys: Sequence[str], year: str, features: Sequence[str],
                    strict: bool = True) -> DataFrame:
    """Pairwise-complete covariances per (keys, cohort, i, j) from the earlier (or all) years.

    Sums per year are additive: one pass over the rows, then running sums over the few years. Values
    are taken from the overall mean first, which leaves covariances as they are and keeps the sums of
    products small.
    """
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    cols = [F.col(f).cast("double") - pool.agg(F.avg(f)).scalar() for f in features]
    aggs = []
    for i, j in pairs:
        both = cols[i].isNotNull() & cols[j].isNotNull()
        aggs.append(F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.count_if(both).alias("n"),
            F.sum(F.when(both, cols[i])).alias("sx"), F.sum(F.when(both, cols[j])).alias("sy"),
            F.sum(F.when(both, cols[i] * cols[j])).alias("sxy")))
    sums = pool.groupBy(*keys, F.col(year).alias("cohort")).agg(F.array(*aggs).alias("m")).select(
        *keys, "cohort", F.explode("m").alias("m")).select(*keys, "cohort", "m.*")
    part = Window.partitionBy(*keys, "i", "j").orderBy("cohort")
    frame = part.rowsBetween(Window.unboundedPreceding, -1) if strict else part.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    past = sums.select(*keys, "cohort", "i", "j", *[F.sum(c).over(frame).alias(c) for c in ("n", "sx", "sy", "sxy")])
    cov = F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1))
    return past.select(*keys, "cohort", "i", "j", "n", cov.alias("cov"))


def calibration_lines(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int) -> DataFrame:
    """Least-squares line per group with enough complete rows."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(*keys).agg(
        F.regr_intercept(F.col(y), F.col(x)).alias("cal_a"), F.regr_slope(F.col(y), F.col(x)).alias("cal_b"),
        F.count("*").alias("cal_n")).where(F.col("cal_n") >= min_rows)


def value_score(df: DataFrame, position: str, expected: str, actual: str, resolved, min_rows: int,
                replacement: float, out: str) -> DataFrame:
    """One scale for all positions: calibrated estimate above the position's replacement level,
    as a share of all rows, in percent."""
    df = materialize(df, "value-score")
    lines = calibration_lines(df.where(resolved), [position], expected, actual, min_rows)
    cal = attach(df, lines, [position]).withColumn(
        "__cal", F.coalesce("cal_a", F.lit(0.0)) + F.coalesce("cal_b", F.lit(1.0)) * F.col(expected))
    level = exact_quantiles(cal, [position], "__cal", [replacement], ["__level"])
    over = attach(cal, level, [position]).withColumn("vorp", F.round(F.col("__cal") - F.col("__level"), 9))
    ranked = cume_dist_in_group(over, [], "vorp", "__cdf")
    return ranked.withColumn(out, F.bround(F.col("__cdf") * 100).cast("int")).drop(
        "cal_a", "cal_b", "cal_n", "__cal", "__level", "__cdf")


def auc_by_group(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Areas under the ROC curve (rank sum of the positives, ties counted half) and the precision-recall curve.

    The latter is average precision: the precision at each positive's score, with ties on one side.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.col(label)).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
    table = prefix_counts(counts, keys, score, ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    found, false = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    precise = F.sum(F.col("pos") * F.try_divide(found, found + false))
    sums = table.groupBy(*keys).agg(wins.alias("w"), precise.alias("p"), F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"))
    return sums.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("w"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
                       F.try_divide(F.col("p"), F.col("n_pos")).alias("pr_auc"))
