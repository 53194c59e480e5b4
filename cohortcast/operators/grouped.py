"""Group statistics brought back to the rows, and row choice within groups.

An unordered window sends a whole group to one task. Here the group is reduced with map-side
aggregation and joined back, so adaptive execution can broadcast a small result or split a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left",
           null_safe: bool = True) -> DataFrame:
    """Join the non-key columns of `other` (one row per key) to `df`."""
    renamed = other.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        right = renamed[f"__on_{k}"]
        cond = cond & (df[k].eqNullSafe(right) if null_safe else df[k] == right)
    return df.join(renamed, cond, how).drop(*[f"__on_{k}" for k in keys])


def add_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Add aggregates of each row's group to the row."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                  ties: bool = False, rank_col: str | None = None) -> DataFrame:
    """Best `n` rows of each group.

    `order` must end in a unique key unless `ties` is wanted. The rank filter is applied by Spark
    before the shuffle as well (window group limit), so a hot group sends `n` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    rank = F.rank() if ties else F.row_number()
    name = rank_col or "__rank"
    out = df.withColumn(name, rank.over(window)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the first in `order`."""
    return top_per_group(df, keys, order, 1)


def modal_value(df: DataFrame, keys: Sequence[str], value: str, out: str,
                count_col: str | None = None) -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    chosen = best_row(counts, keys, [F.col("__n").desc(), F.col(value).asc()])
    cols = [*keys, F.col(value).alias(out)]
    if count_col:
        cols.append(F.col("__n").alias(count_col))
    return chosen.select(*cols)


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """value / group total; null where the total is 0."""
    stats = add_group_stats(df, keys, F.sum(value).alias("__total"))
    return stats.withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def others_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Group total without the row's own part, floored at 0, null when the own value is null."""
    stats = add_group_stats(df, keys, F.sum(value).alias("__total"))
    rest = F.col("__total") - F.col(value)
    return stats.withColumn(out, F.when(rest.isNotNull(), F.greatest(rest, F.lit(0)))).drop("__total")


def center_in_group(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    stats = add_group_stats(df, keys, F.avg(value).alias("__mean"))
    return stats.withColumn(out, F.col(value) - F.col("__mean")).drop("__mean")


def zscore_in_group(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                    suffix: str = "_z") -> DataFrame:
    """Standardise within the group; only centre where the spread is 0 or unknown."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"__m_{v}"), F.stddev_samp(v).alias(f"__s_{v}"))]
    out = add_group_stats(df, keys, *aggs)
    for v in values:
        diff = F.col(v) - F.col(f"__m_{v}")
        spread = F.col(f"__s_{v}")
        out = out.withColumn(f"{v}{suffix}", F.when(spread > 0, diff / spread).otherwise(diff))
    return out.drop(*[f"__{p}_{v}" for v in values for p in "ms"])


def collapse_duplicates(df: DataFrame, keys: Sequence[str], max_cols: Sequence[str],
                        first_cols: Sequence[str], order: Column) -> DataFrame:
    """One row per key: maxima of some columns, the value of others at the first row in `order`."""
    return df.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in max_cols],
        *[F.min_by(c, order).alias(c) for c in first_cols],
    )
