"""Evaluation: folds, error tables, calibration, sweeps and honest selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators.grouped import attach, best_row, top_per_group


def rolling_folds(df: DataFrame, year: str, years: Sequence[int]) -> DataFrame:
    """Every row once per fold: `test` in its own year, `train` before it."""
    out = df.withColumn("fold", F.explode(F.array(*[F.lit(y) for y in years]))).where(F.col(year) <= F.col("fold"))
    return out.withColumn("role", F.when(F.col(year) == F.col("fold"), "test").otherwise("train"))


def expanding_folds(df: DataFrame, year: str, cutoffs: Sequence[int], horizon: int) -> DataFrame:
    """Train up to each cut-off, test on the following `horizon` years."""
    out = df.withColumn("fold", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    out = out.where(F.col(year) <= F.col("fold") + horizon)
    return out.withColumn("role", F.when(F.col(year) <= F.col("fold"), "train").otherwise("test"))


def usable_folds(folds: DataFrame, keys: Sequence[str], label: str, min_train: int, min_test: int,
                 min_positive: int) -> DataFrame:
    """Folds with enough training rows, test rows and positive training labels."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    return folds.groupBy("fold", *keys).agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"),
        F.count_if(train & (F.col(label) == 1)).alias("n_positive")).where(
        (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test) & (F.col("n_positive") >= min_positive))


def error_aggregates(actual: str, predicted: str, p: str | None = None, label: str | None = None) -> list[Column]:
    """Absolute, squared, signed (predicted - actual) error and correlation; accuracy and Brier score."""
    a, b = F.col(actual), F.col(predicted)
    out = [F.count("*").alias("n"), F.avg(F.abs(b - a)).alias("mae"), F.sqrt(F.avg((b - a) * (b - a))).alias("rmse"),
           F.corr(a, b).alias("cor"), F.avg(b - a).alias("bias")]
    if p:
        y = F.col(label)
        out += [F.avg(((F.col(p) > 0.5).cast("int") == y).cast("double")).alias("accuracy"),
                F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier")]
    return out


def error_table(df: DataFrame, group: str, aggs: Sequence[Column], overall: str = "ALL") -> DataFrame:
    """Metrics per group value and over all rows, from one pass."""
    return df.rollup(group).agg(*aggs, F.grouping(group).alias("__all")).withColumn(
        group, F.when(F.col("__all") == 1, F.lit(overall)).otherwise(F.col(group))).drop("__all")


def interval_label(x: Column, breaks: Sequence[float]) -> Column:
    """0-based index of the right-closed interval holding x (the lowest break is included)."""
    out = F.when(x < breaks[0], F.lit(None).cast("int"))
    for i, hi in enumerate(breaks[1:]):
        out = out.when(x <= hi, i)
    return out


def calibration_table(df: DataFrame, keys: Sequence[str], p: str, label: str, breaks: Sequence[float],
                      min_rows: int) -> DataFrame:
    binned = df.withColumn("bin", interval_label(F.col(p), breaks)).where(F.col("bin").isNotNull())
    return binned.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed")).where(
        F.col("n") >= min_rows)


def multiclass_row_metrics(probs: Column, observed: Column, eps: float = 1e-12) -> dict[str, Column]:
    """Per-row log-loss, top-1, top-2 and adjacent hits of a probability array."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("k"), i.alias("i"))))
    top1, top2 = F.get(ranked, F.lit(0))["i"], F.get(ranked, F.lit(1))["i"]
    p_obs = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.get(probs, observed)))
    return {"log_loss": -F.log(p_obs), "top1": (top1 == observed).cast("double"),
            "top2": ((top1 == observed) | (top2 == observed)).cast("double"),
            "adjacent": (F.abs(top1 - observed) <= 1).cast("double")}


def pinball(actual: Column, predicted: Column, tau: float) -> Column:
    e = actual - predicted
    return F.greatest(tau * e, (tau - 1) * e)


def combiner_settings() -> list[tuple[str, float, float, float]]:
    """(transform, alpha, beta, gamma) of every combiner tried."""
    alphas = [round(0.05 * i, 2) for i in range(21)]
    betas = [round(0.025 * i, 3) for i in range(-6, 7)]
    out = [("identity", 1.0, 0.0, 1.0), ("isotonic", 1.0, 0.0, 1.0)]
    out += [(t, a, 0.0, 1.0) for t in ("shrink", "iso_shrink") for a in alphas]
    out += [(t, a, b, 1.0) for t in ("linear", "iso_linear") for a in alphas for b in betas]
    return out + [("power_shrink", a, 0.0, g) for a in alphas for g in presets.GAMMA_GRID]


SETTING = ("transform", "alpha", "beta", "gamma")
ROWS_AT_ONCE, KEYS_AT_ONCE = 256, 1000  # a task holds that many rows, and sums of that many keys, against all settings


def _setting_errors(rows: np.ndarray) -> np.ndarray:
    """Absolute error of every row (p_made_it, p_iso, base_rate, prod_pred, ppg) under every setting, NaN where the outcome is missing; a missing estimate counts as 0."""
    p, iso, base, value, actual = rows.T[:, :, None]
    settings = combiner_settings()
    kind = np.array([s[0] for s in settings])
    alpha, beta, gamma = (np.array([s[i] for s in settings], float) for i in (1, 2, 3))
    start = np.where(np.isin(kind, ["isotonic", "iso_shrink", "iso_linear"]), iso, p)
    powered = np.isin(kind, ["power_shrink"])
    start = np.where(powered, np.power(p, gamma), start)
    shrunk = alpha * start + (1 - alpha) * base
    mixed = np.where(np.isin(kind, ["linear", "iso_linear"]), alpha * start + beta, shrunk)
    p_eff = np.where(np.isin(kind, ["identity", "isotonic"]), start, np.clip(mixed, 0.0, 1.0))
    return np.abs(actual - np.fmax(p_eff * value, 0.0))


def combiner_errors(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute-error sums of every combiner setting per key.

    Columns needed: p_made_it, p_iso, base_rate, prod_pred, ppg. A task lays a few rows at a time against all settings as arrays, adds
    them up per key, and sends on one sum per key and setting; rows are neither copied nor shuffled.
    """
    inputs = ["p_made_it", "p_iso", "base_rate", "prod_pred", "ppg"]
    n_keys, settings = len(keys), combiner_settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        fields: list[pa.DataType] = []

        def sums() -> pa.RecordBatch:
            errors = [[float(v) if ok else None for v, ok in zip(s, seen)] for _, s, seen in held.values()]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in held], fields[i]) for i in range(n_keys)), pa.array([n for n, _, _ in held.values()], pa.int64()),
                 pa.array(errors, pa.list_(pa.float64()))], names=[*keys, "n", "errors"])

        for big in batches:
            fields = [big.schema.field(i).type for i in range(n_keys)]
            for at in range(0, big.num_rows, ROWS_AT_ONCE):
                batch = big.slice(at, ROWS_AT_ONCE)
                table = np.stack([batch.column(n_keys + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(inputs))], 1)
                errors = _setting_errors(table)
                groups: dict[tuple, list[int]] = {}
                for row, key in enumerate(zip(*[batch.column(i).to_pylist() for i in range(n_keys)])):
                    groups.setdefault(key, []).append(row)
                for key, rows in groups.items():
                    known = ~np.isnan(errors[rows])
                    n, total, seen = held.get(key, (0, 0.0, False))
                    held[key] = [n + len(rows), total + np.where(known, errors[rows], 0.0).sum(0), seen | known.any(0)]
                if len(held) > KEYS_AT_ONCE:
                    yield sums()
                    held.clear()
        if held:
            yield sums()

    kinds = dict(df.dtypes)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in inputs])
    parts = rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, errors array<double>")
    sums = parts.select(*keys, "n", F.posexplode("errors").alias("i", "e")).groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.sum("e").alias("err"))
    columns = {name: F.array(*[F.lit(s[i]) for s in settings]) for i, name in enumerate(SETTING)}
    return sums.select(*keys, *[F.get(column, F.col("i")).alias(name) for name, column in columns.items()], "n", "err")


def leave_one_fold_out(errors: DataFrame, group: Sequence[str], fold: str) -> DataFrame:
    """Best setting on all other folds and its error on the one held out.

    `errors` holds (group, fold, setting, n, err); ties go to the alphabetically first setting.
    """
    totals = errors.groupBy(*group, *SETTING).agg(F.sum("n").alias("__n"), F.sum("err").alias("__e"))
    rest = attach(errors, totals, [*group, *SETTING])
    rest = rest.withColumn("train_mae", F.round(F.try_divide(F.col("__e") - F.col("err"), F.col("__n") - F.col("n")), 9))
    best = best_row(rest, [*group, fold], [F.col("train_mae").asc_nulls_last(), *[F.col(c).asc() for c in SETTING]])
    return best.select(*group, fold, *SETTING, "n", "train_mae", (F.col("err") / F.col("n")).alias("test_mae"))


def blend_errors(df: DataFrame, keys: Sequence[str], actual: str, main: str, other: str, steps: int = 20) -> DataFrame:
    """Mean absolute error of w*other + (1-w)*main for w = 0..1, per group and over all rows."""
    both = df.where(F.col(main).isNotNull() & F.col(other).isNotNull())
    aggs = [F.avg(F.abs(F.col(actual) - ((i / steps) * F.col(other) + (1 - i / steps) * F.col(main)))).alias(f"w{i}")
            for i in range(steps + 1)]
    wide = both.rollup(*keys).agg(F.array(*aggs).alias("maes"), F.count("*").alias("n"))
    return wide.select(*[F.coalesce(k, F.lit("ALL")).alias(k) for k in keys], "n", F.posexplode("maes").alias("i", "mae")).select(
        *keys, "n", (F.col("i") / float(steps)).alias("weight"), "mae")


def best_setting(table: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str]) -> DataFrame:
    return top_per_group(table, keys, [F.round(metric, 9).asc(), *[F.col(t).asc() for t in tie]], 1)
