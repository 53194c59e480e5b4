"""Row-level scores: combiners, hurdle, blends, buckets, composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortcast import presets


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def deployed_combiner(position: Column, p: Column, p_iso: Column,
                      settings: Mapping[str, tuple] = presets.COMBINERS) -> Column:
    """Clipped probability per position, without the pull to a base rate."""
    out = None
    for pos, (transform, alpha, beta, gamma) in settings.items():
        raw = p_iso if transform.startswith("iso") else p
        value = clip01(alpha * F.pow(raw, F.lit(gamma)) + beta)
        out = F.when(position == pos, value) if out is None else out.when(position == pos, value)
    return out.otherwise(p)


def hurdle(p_eff: Column, log_value: Column) -> Column:
    value = p_eff * F.exp(log_value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def by_position(position: Column, table: Mapping[str, float], default: Column | float | None = None) -> Column:
    out = None
    for pos, v in table.items():
        out = F.when(position == pos, F.lit(v)) if out is None else out.when(position == pos, F.lit(v))
    return out.otherwise(F.lit(None) if default is None else default)


def blend(position: Column, main: Column, other: Column, main_weight: Mapping[str, float]) -> Column:
    """Weighted mean of two estimates; the main one alone where the other or the weight is missing."""
    w = by_position(position, main_weight)
    return F.coalesce(w * main + (1 - w) * other, main)


def assign_bucket(value: Column, position: Column, cuts: Mapping[str, Sequence[float]] = presets.BUCKET_CUTS) -> Column:
    """0-based outcome bucket: at or below the first cut, then half-open intervals from below."""
    out = None
    for pos, (zero, *rest) in cuts.items():
        level = F.when(value <= zero, 0)
        for i, c in enumerate(rest, start=1):
            level = level.when(value < c, i)
        level = level.when(value.isNotNull(), len(rest) + 1)
        out = F.when(position == pos, level) if out is None else out.when(position == pos, level)
    return out


def expectation(probs: Column, midpoints: Column) -> Column:
    """Sum of probability x midpoint over the buckets."""
    return F.aggregate(F.zip_with(probs, midpoints, lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x)


def midpoints_of(position: Column, table: Mapping[str, Sequence[float]] = presets.BUCKET_MIDPOINTS) -> Column:
    out = None
    for pos, mids in table.items():
        arr = F.array(*[F.lit(float(m)) for m in mids])
        out = F.when(position == pos, arr) if out is None else out.when(position == pos, arr)
    return out


def geometric_ensemble(p: Column, q: Column) -> Column:
    """Normalised square root of the product of two probability arrays."""
    raw = F.zip_with(p, q, lambda a, b: F.sqrt(a * b))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def composite_score(upside_rank: Column, value_rank: Column, comp_rank: Column, p_bust: Column,
                    comp_bust: Column, p_hit: Column, has_buckets: Column) -> Column:
    """0-100 composite from percentile ranks and safeties; a shorter formula without bucket data."""
    a, b, c, d, e = presets.SCORE_WEIGHTS
    fa, fb, fc, fd = presets.SCORE_FALLBACK_WEIGHTS
    safe = (1 - F.coalesce(p_bust, F.lit(presets.SCORE_DEFAULT_BUST))) * 100
    comp_safe = (1 - F.coalesce(comp_bust, F.lit(presets.SCORE_DEFAULT_COMP_BUST))) * 100
    hit = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (p_hit - 0.5) / 0.5 * 100))
    full = a * upside_rank + b * value_rank + c * safe + d * comp_rank + e * comp_safe
    short = fa * hit + fb * value_rank + fc * comp_rank + fd * comp_safe
    return F.when(has_buckets, full).otherwise(short)


def speed_score(weight: Column, forty: Column) -> Column:
    return weight * 200 / F.pow(forty, F.lit(4))


def conditional_value(expected: Column, p: Column) -> Column:
    return F.when(p > 0, expected / p)
