"""Feature recipe: zero fill, category levels, imputation, variance filter, weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.operators.grouped import top_per_group
from cohortcast.operators.ranks import exact_quantiles
from cohortcast.operators.stats import long_features


def zero_fill(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Features become 0 where their coverage flag is 0; absent flags and features are skipped."""
    have, fixes = set(df.columns), {}
    for flag, features in rules.items():
        if flag in have:
            for f in features:
                if f in have:
                    fixes[f] = F.when(F.col(flag) == 0, F.lit(0.0)).otherwise(F.col(f))
    return df.withColumns(fixes) if fixes else df


def one_hot(df: DataFrame, column: str, levels: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """0/1 column per known level and one for everything else, missing included."""
    seen = F.coalesce(F.col(column).isin(list(levels)), F.lit(False))
    return df.select("*", *[
        F.coalesce((F.col(column) == lv).cast("int"), F.lit(0)).alias(f"{column}_{lv}") for lv in levels],
        (~seen).cast("int").alias(f"{column}_{unknown}"))


def learn_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact medians of the training rows as (feature, med)."""
    return exact_quantiles(long_features(train, [], features), ["feature"], "value", [0.5], ["med"])


def impute(df: DataFrame, medians: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features take the learned medians (scalar subqueries on the parameter table)."""
    def learned(f: str) -> Column:
        return medians.agg(F.max(F.when(F.col("feature") == f, F.col("med")))).scalar()

    return df.withColumns({f: F.coalesce(F.col(f), learned(f)) for f in features})


def near_zero_variance(df: DataFrame, features: Sequence[str], freq_cut: float = 95 / 5,
                       unique_cut: float = 10.0) -> DataFrame:
    """Per feature the ratio of its two commonest values, the share of distinct ones, and the verdict."""
    counts = long_features(df, [], features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n_rows"))
    top = top_per_group(counts, ["feature"], [F.col("n").desc(), F.col("value").asc()], 2, rank_col="rk").groupBy("feature").agg(
        F.max(F.when(F.col("rk") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("rk") == 2, F.col("n"))).alias("n2"))
    ratio = F.when(F.col("n2").isNull(), F.lit(0.0)).otherwise(F.col("n1") / F.col("n2"))
    pct = F.lit(100.0) * F.col("n_unique") / F.col("n_rows")
    return totals.join(top, "feature").select(
        "feature", "n_unique", ratio.alias("freq_ratio"), pct.alias("pct_unique"),
        ((F.col("n_unique") == 1) | ((ratio > freq_cut) & (pct <= unique_cut))).alias("near_zero"))


def era_weight(year: Column, before: int, weight: float) -> Column:
    return F.when(year < before, F.lit(weight)).otherwise(F.lit(1.0))


def class_balance(df: DataFrame, label: str, out: str) -> DataFrame:
    """Weight of the positive class = negatives / positives, 1 for the negatives."""
    ratio = df.agg(F.try_divide(F.sum(1 - F.col(label)), F.sum(label))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))
