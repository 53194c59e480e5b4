"""Exact ranks, distribution functions and quantiles that no single task has to sort alone.

All of them derive from one table: per (group, distinct value) the number of rows holding the value
and the number of rows below it. Equal values are counted before any shuffle. Running sums are taken
over ranges inside ranges: a value's place on a fixed monotone scale (2^21 ranges per doubling) gives
nested ranges of 2^16 members each, every window sees one range, and the sums of the ranges before it
are added. The scale is fixed, so there is one plan for every size and nothing runs before the caller asks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.operators.grouped import attach

RANGE_BITS = 16
LEVELS = 2
SCALE_BITS = 21  # LEVELS * RANGE_BITS less the bits in front of the point


def _place(value: str) -> Column:
    """Number of the value's finest range; never falls as the value grows, infinities and NaN (above all) included."""
    v = F.col(value).cast("double")
    even = F.signum(v) * F.log2(F.abs(v) * F.lit(2.0 ** 40) + 1)
    # the product overflows for the very largest numbers, which then share the outermost range
    bounded = F.when(F.isnan(v), 2001.0).when(F.abs(v) == float("inf"), F.signum(v) * 2000.0).otherwise(
        F.greatest(F.lit(-1999.0), F.least(F.lit(1999.0), even)))
    return F.coalesce(F.floor(bounded * F.lit(2.0 ** SCALE_BITS)), F.lit(-(1 << 62))).cast("bigint")


def _range_offsets(sums: DataFrame, measures: Sequence[str], level: int) -> DataFrame:
    """Per (__key, __range): sums over the key's earlier ranges and over the whole key."""
    if level == 1:
        before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(
            "__key", "__range", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__off_{m}") for m in measures],
            *[F.sum(m).over(Window.partitionBy("__key")).alias(f"{m}_total") for m in measures])
    inner = sums.withColumn("__outer", F.shiftright("__range", RANGE_BITS))
    outer = inner.groupBy("__key", F.col("__outer").alias("__range")).agg(*[F.sum(m).alias(m) for m in measures])
    outer = _range_offsets(outer, measures, level - 1).withColumnRenamed("__range", "__outer")
    before = Window.partitionBy("__key", "__outer").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = inner.select("__key", "__outer", "__range", *[
        F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__in_{m}") for m in measures])
    return placed.join(outer, ["__key", "__outer"]).select(
        "__key", "__range", *[(F.col(f"__off_{m}") + F.col(f"__in_{m}")).alias(f"__off_{m}") for m in measures],
        *[f"{m}_total" for m in measures])


def prefix_counts(counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Add `<m>_below` (sum over smaller values) and `<m>_total` for each measure.

    `counts` has one row per (keys, value); the value is numeric and may be infinite or NaN.
    """
    # one struct key: equal where the same parts are null
    table = counts.withColumn("__key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).withColumn("__range", _place(value))
    sums = table.groupBy("__key", "__range").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = _range_offsets(sums, measures, LEVELS)
    local = Window.partitionBy("__key", "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = table.select(
        "*", *[F.coalesce(F.sum(m).over(local), F.lit(0)).alias(f"__in_{m}") for m in measures])
    return inner.join(offsets, ["__key", "__range"]).select(
        *counts.columns,
        *[(F.col(f"__off_{m}") + F.col(f"__in_{m}")).alias(f"{m}_below") for m in measures],
        *[F.col(f"{m}_total") for m in measures],
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per (keys, value): n, n_below, n_total over the non-null rows."""
    counts = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*keys, value).agg(F.count("*").alias("n")))
    return prefix_counts(counts, keys, value, ["n"])


def percent_rank_in_group(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(rank - 1) / (rows - 1) over the non-null rows; null elsewhere and for single-row groups."""
    pos = value_positions(df, keys, value).select(
        *keys, value, F.try_divide(F.col("n_below"), F.col("n_total") - 1).alias(out))
    return attach(df, pos, [*keys, value])


def percent_ranks(df: DataFrame, keys: Sequence[str], outs: dict[str, str]) -> DataFrame:
    """Percent ranks of several columns (column -> output name) from one shared count table."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in outs]).unpivot(
        list(keys), list(outs), "__feature", "__value")
    pos = value_positions(long, [*keys, "__feature"], "__value").select(
        *keys, "__feature", "__value", F.try_divide(F.col("n_below"), F.col("n_total") - 1).alias("__rank"))
    out = df
    for c, name in outs.items():
        one = pos.where(F.col("__feature") == c).select(
            *keys, F.col("__value").alias(f"__v_{c}"), F.col("__rank").alias(name))
        out = attach(out.withColumn(f"__v_{c}", F.col(c).cast("double")), one, [*keys, f"__v_{c}"]).drop(f"__v_{c}")
    return out


def cume_dist_in_group(df: DataFrame, keys: Sequence[str], value: str, out: str, whole: int = 1) -> DataFrame:
    """Share of non-null rows with a value not above the row's own, in parts of `whole`.

    The count is multiplied before the one division, so that a share that ends in a half is a half.
    """
    pos = value_positions(df, keys, value).select(
        *keys, value, (whole * (F.col("n_below") + F.col("n")) / F.col("n_total")).alias(out))
    return attach(df, pos, [*keys, value])


def row_index_in_group(df: DataFrame, keys: Sequence[str], value: str, tie_break: str, out: str) -> DataFrame:
    """0-based position in ascending (value, tie_break) order; both numeric, tie_break unique.

    Rows below come from the value counts; the position among equal values from a second pass, so a
    value shared by a third of the rows is no single task's work either.
    """
    lower = value_positions(df, keys, value).select(
        *keys, value, F.col("n_below").alias("__lower"))
    within = value_positions(df, [*keys, value], tie_break).select(
        *keys, value, tie_break, F.col("n_below").alias("__within"))
    out_df = attach(attach(df, lower, [*keys, value]), within, [*keys, value, tie_break])
    return out_df.withColumn(out, F.col("__lower") + F.col("__within")).drop("__lower", "__within")


def distribution_against(probe: DataFrame, reference: DataFrame, keys: Sequence[str], value: str,
                         out: str, whole: int = 1) -> DataFrame:
    """Share of `reference` values not above each probe value, in parts of `whole`; null where either side is empty."""
    ok = F.col(value).isNotNull()
    ref = reference.where(ok).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ask = probe.where(ok).select(*keys, value).distinct().withColumn("n", F.lit(0).cast("bigint"))
    counts = ref.unionByName(ask).groupBy(*keys, value).agg(F.sum("n").alias("n"))
    pos = prefix_counts(counts, keys, value, ["n"]).select(
        *keys, value, F.try_divide(whole * (F.col("n_below") + F.col("n")), F.col("n_total")).alias(out))
    return attach(probe, pos, [*keys, value])


SPLITS = 65_536


def _wanted(probs: Sequence[float], total: Column) -> list[tuple[Column, Column]]:
    """(position, the one above it) whose values each quantile lies between."""
    return [(F.floor(F.lit(float(p)) * (total - 1)), F.ceil(F.lit(float(p)) * (total - 1))) for p in probs]


def _holding(sums: DataFrame, by: Sequence[str], order: str, start: Column, probs: Sequence[float]) -> DataFrame:
    """Rows of `sums` (counts in `__n`) that hold a wanted position, with the rows below them in `__below`."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("__below", start + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    hit = F.lit(False)
    for pair in _wanted(probs, F.col("__total")):
        for index in pair:
            hit = hit | ((F.col("__below") <= index) & (index < F.col("__below") + F.col("__n")))
    return placed.where(hit)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    outs: Sequence[str],
                    weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any group size, found by selection.

    Counts per range of the fixed scale tell which ranges hold the wanted positions. Those are split evenly between their
    smallest and largest value, whatever their offset, and only values of the pieces that hold a position are put in order.
    With `weight`, `df` already holds counted values and the column gives the count; values may repeat.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        key.alias("__key"), F.col(value).cast("double").alias("__v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__n"))
    rows = rows.groupBy("__key", "__v").agg(F.sum("__n").alias("__n")).withColumn("__range", F.shiftright(_place("__v"), RANGE_BITS))
    ranges = rows.groupBy("__key", "__range").agg(F.sum("__n").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    ranges = ranges.withColumn("__total", F.sum("__n").over(Window.partitionBy("__key")))
    ranges = _holding(ranges, ["__key"], "__range", F.lit(0), probs).select("__key", "__range", "__low", "__high", "__total", F.col("__below").alias("__start"))
    width = F.col("__high") - F.col("__low")
    piece = F.when(width > 0, F.floor((F.col("__v") - F.col("__low")) / width * (SPLITS - 1))).otherwise(0).cast("int")
    near = rows.join(ranges, ["__key", "__range"]).withColumn("__piece", piece)
    pieces = near.groupBy("__key", "__range", "__piece").agg(F.sum("__n").alias("__n"), F.first("__start").alias("__start"), F.first("__total").alias("__total"))
    pieces = _holding(pieces, ["__key", "__range"], "__piece", F.col("__start"), probs).select("__key", "__range", "__piece", F.col("__below").alias("__start"))
    last = near.drop("__start").join(pieces, ["__key", "__range", "__piece"])
    last = _holding(last, ["__key", "__range", "__piece"], "__v", F.col("__start"), probs)
    aggs: list[Column] = []
    for i, (p, pair) in enumerate(zip(probs, _wanted(probs, F.col("__total")))):
        for side, index in zip(("lo", "hi"), pair):
            holds = (F.col("__below") <= index) & (index < F.col("__below") + F.col("__n"))
            aggs.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{side}{i}"))
        aggs.append(F.max(F.lit(float(p)) * (F.col("__total") - 1) - pair[0]).alias(f"__f{i}"))
    picked = last.groupBy("__key").agg(*aggs)
    return picked.select(*[F.col(f"__key.{k}") for k in keys], *[
        F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}")).otherwise(
            F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(o)
        for i, o in enumerate(outs)])
