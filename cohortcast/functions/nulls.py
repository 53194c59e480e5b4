"""Column helpers whose null rules differ from the plain Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pmax_na(x: Column, *others: Column) -> Column:
    """Greatest value, null when any input is null (`greatest` skips nulls)."""
    cols = (x, *others)
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return F.when(ok, F.greatest(*cols))


def pmin_na(x: Column, *others: Column) -> Column:
    """Least value, null when any input is null."""
    cols = (x, *others)
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return F.when(ok, F.least(*cols))


def if_else_na(cond: Column, yes: Column, no: Column) -> Column:
    """Conditional that stays null where the condition itself is unknown."""
    return F.when(cond, yes).when(~cond, no)


def in_or_null(x: Column, values: Sequence) -> Column:
    """Membership test that also accepts a missing value and never returns null."""
    return F.coalesce(x.isin(list(values)), F.lit(False)) | x.isNull()


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1): counts as denominators, never a division by zero."""
    return num / F.greatest(den, F.lit(1))


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, null where den is zero or missing."""
    return F.try_divide(num, den)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return pmin_na(pmax_na(x, F.lit(lo)), F.lit(hi))


def sum0(x: Column | str) -> Column:
    """Sum that is 0 for an all-null group."""
    return F.coalesce(F.sum(x), F.lit(0))


def sum_if(cond: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0))


def weighted_mean(x: Column, w: Column) -> Column:
    both = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))
