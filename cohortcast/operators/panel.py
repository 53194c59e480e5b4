"""Panel features: targets, shrinkage, first-threshold ages, transitions, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.nulls import sum_if
from cohortcast.operators.grouped import add_group_stats, attach, best_row, top_per_group


def weighted_best(df: DataFrame, keys: Sequence[str], rate: str, weight: str, tie_break: str,
                  n: int) -> DataFrame:
    """Plain and weighted mean of the `n` best periods of each key, with their weight and number."""
    best = top_per_group(df, keys, [F.col(rate).desc_nulls_last(), F.col(tie_break).asc()], n)
    return best.groupBy(*keys).agg(
        F.avg(rate).alias("raw_ppg"),
        (F.sum(F.col(rate) * F.col(weight)) / F.sum(weight)).alias("weighted_ppg"),
        F.sum(weight).alias("top2_games"), F.count("*").alias("n_qual"))


def shrink_to_group(df: DataFrame, group: Sequence[str], value: str, size: str, prior_weight: float,
                    out: str) -> DataFrame:
    """Pull each value towards its group mean, the more the smaller its own sample."""
    stats = add_group_stats(df, group, F.avg(value).alias("__prior"))
    n = F.col(size)
    return stats.withColumn(
        out, (n * F.col(value) + prior_weight * F.col("__prior")) / (n + prior_weight)).drop("__prior")


def first_threshold(df: DataFrame, keys: Sequence[str], age: str, share: str, volume: str,
                    threshold: float, share_before: float, volume_before: float,
                    never_age: float, ages: tuple[float, float]) -> DataFrame:
    """Youngest age at which the share reaches the threshold, and peaks before given ages."""
    a, s = F.col(age), F.col(share)
    reached = s >= threshold
    out = df.where(a.between(*ages)).groupBy(*keys).agg(
        F.count("*").alias("n_seasons"),
        F.min(F.when(reached, a)).alias("breakout_age"),
        F.max(F.when(a < share_before, s)).alias("peak_share"),
        F.max(F.when(a < volume_before, F.col(volume))).alias("peak_volume"),
        F.count_if(reached).alias("n_dominant"))
    return out.withColumns({
        "has_breakout": F.col("breakout_age").isNotNull().cast("int"),
        "breakout_age_imputed": F.coalesce("breakout_age", F.lit(never_age))})


def season_transitions(roster: DataFrame, ids: str, season: str, team: str) -> DataFrame:
    """Each roster row with the team of the following season and whether the entity stayed."""
    following = roster.select(F.col(ids), (F.col(season) - 1).alias(season), F.col(team).alias("next_team"))
    out = roster.join(following, [ids, season], "left")
    return out.withColumn("stayed", F.coalesce(F.col("next_team") == F.col(team), F.lit(False)))


def vacated_share(transitions: DataFrame, keys: Sequence[str], volume: str, threshold: float,
                  totals: DataFrame, total: str) -> DataFrame:
    """Share of a team's volume that left, and how many returning entities exceed a volume."""
    stayed = F.col("stayed")
    left = transitions.groupBy(*keys).agg(
        sum_if(~stayed, F.col(volume)).alias("vacated"),
        F.count_if(stayed & (F.col(volume) >= threshold)).alias("n_returning"))
    out = attach(left, totals.select(*keys, total), keys, null_safe=False)
    return out.withColumn("vacated_share", F.when(F.col(total) > 0, F.col("vacated") / F.col(total)))


def top_incumbent(transitions: DataFrame, keys: Sequence[str], volume: str, tie_break: str) -> DataFrame:
    """The returning entity with the largest volume in each group."""
    ready = transitions.where(F.col("stayed") & F.col(volume).isNotNull())
    return best_row(ready, keys, [F.col(volume).desc(), F.col(tie_break).asc()])


def age_on(birth: Column, year: Column, month: int = 9, day: int = 1) -> Column:
    """Age in years at a reference day of `year`."""
    return F.datediff(F.make_date(year, F.lit(month), F.lit(day)), birth) / 365.25


def age_curve(df: DataFrame, keys: Sequence[str], age: str, value: str,
              bounds: tuple[int, int]) -> DataFrame:
    """Mean, spread and count of each entity's best value by clamped, rounded age."""
    best = df.where(F.col(value).isNotNull()).groupBy(*keys, age).agg(F.max(value).alias("__best"))
    bucket = curve_key(F.col(age), bounds)
    return best.groupBy(bucket.alias("age_bucket")).agg(
        F.count("*").alias("n"), F.avg("__best").alias("mean"), F.stddev_samp("__best").alias("sd"))


def curve_key(age: Column, bounds: tuple[int, int]) -> Column:
    lo, hi = bounds
    return F.when(age.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(age).cast("int"))))


def curve_residual(df: DataFrame, curve: DataFrame, age: str, value: str,
                   bounds: tuple[int, int]) -> DataFrame:
    """Residual and z-score of a value against the age curve (a curve holds one row per age)."""
    keyed = df.withColumn("__key", curve_key(F.col(age), bounds))
    small = F.broadcast(curve.where(F.col("age_bucket").between(*bounds)).select(
        F.col("age_bucket").alias("__key"), F.col("mean").alias("__m"), F.col("sd").alias("__s")))
    diff = F.col(value) - F.col("__m")
    return keyed.join(small, "__key", "left").withColumns({
        "age_resid": diff, "age_z": F.when(F.col("__s") > 0, diff / F.col("__s"))}).drop("__key", "__m", "__s")


def value_curve(df: DataFrame, slot: str, value: str, last_slot: int) -> DataFrame:
    """Monotone-by-fit worth of each slot, slot 1 = 100.

    Weighted least squares of log(mean + 1) on (slot, slot^2): the moments of at most `last_slot`
    slots are summed in one aggregation and the 3x3 normal equations solved as column arithmetic.
    """
    per_slot = df.groupBy(slot).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where("n > 0")
    x, w, y = F.col(slot).cast("double"), F.col("n").cast("double"), F.log(F.col("m") + 1)
    moments = per_slot.agg(
        *[F.sum(w * F.pow(x, F.lit(p))).alias(f"s{p}") for p in range(5)],
        *[F.sum(w * F.pow(x, F.lit(p)) * y).alias(f"t{p}") for p in range(3)])
    s = [F.col(f"s{p}") for p in range(5)]
    t = [F.col(f"t{p}") for p in range(3)]

    def det(a, b, c):
        return (a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0])
                + a[2] * (b[0] * c[1] - b[1] * c[0]))

    rows = [s[0:3], s[1:4], s[2:5]]
    full = det(*rows)

    def solved(column):
        swapped = [[t[i] if j == column else rows[i][j] for j in range(3)] for i in range(3)]
        return det(*swapped) / full

    fit = moments.select(*[solved(i).alias(f"b{i}") for i in range(3)])
    grid = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(last_slot))).alias("slot"))
    k = F.col("slot").cast("double")
    log_pred = F.col("b0") + F.col("b1") * k + F.col("b2") * k * k
    first = F.greatest(F.exp(F.col("b0") + F.col("b1") + F.col("b2")) - 1, F.lit(0.0))
    return grid.select("slot", log_pred.alias("log_pred"),
                       (F.greatest(F.exp(log_pred) - 1, F.lit(0.0)) * F.lit(100.0) / first).alias("worth"))
