"""Rule lists turned into one column expression: points, strengths, concerns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortcast.functions.nulls import is_true
from cohortcast.functions.text import capitalise_first
from cohortcast.talking_points import Chain

def points(rules: Sequence[tuple[Column, Column]], fallbacks: Sequence[tuple[Column, Column]] = (),
           limit: int = 3) -> Column:
    """Texts of the firing rules in order, the first `limit` kept, one fallback when none fires."""
    fired = F.filter(F.array(*[F.when(is_true(c), t) for c, t in rules]), lambda p: p.isNotNull())
    backup = F.coalesce(*[F.when(is_true(c), t) for c, t in fallbacks]) if fallbacks else F.lit(None).cast("string")
    chosen = F.when(F.size(fired) > 0, fired).when(backup.isNotNull(), F.array(backup)).otherwise(
        F.array().cast("array<string>"))
    return F.transform(F.slice(chosen, 1, limit), capitalise_first)


def first_of(*pairs: tuple[Column, Column]) -> tuple[Column, Column]:
    """Exclusive alternatives as one rule: the text of the first that fires."""
    test, text = F.lit(False), None
    for c, t in pairs:
        c = is_true(c)
        test = test | c
        text = F.when(c, t) if text is None else text.when(c, t)
    return test, text


def strengths(values: Mapping[str, Column], at_least: float, top: int) -> Column:
    """Labels of the `top` largest values not below a threshold, largest first, ties by label."""
    pairs = F.array(*[F.struct((-v).alias("k"), F.lit(n).alias("label")) for n, v in values.items()])
    kept = F.filter(pairs, lambda p: p["k"] <= -at_least)
    return F.transform(F.slice(F.array_sort(kept), 1, top), lambda p: p["label"])


def concerns(values: Mapping[str, Column], at_most: float, top: int) -> Column:
    """Labels of the `top` smallest values not above a threshold, smallest first, ties by label."""
    pairs = F.array(*[F.struct(v.alias("k"), F.lit(n).alias("label")) for n, v in values.items()])
    kept = F.filter(pairs, lambda p: p["k"] <= at_most)
    return F.transform(F.slice(F.array_sort(kept), 1, top), lambda p: p["label"])


OPERATORS = {"<=": Column.__le__, ">=": Column.__ge__, "<": Column.__lt__, ">": Column.__gt__, "=": Column.__eq__}
PLACEHOLDER = re.compile(r"\{(\w+)(?::([0-9%]))?\}")


def fixed_point(x: Column, places: int) -> Column:
    """A number as text, rounded half up to `places` decimals; 0 places drop the fraction."""
    if places == 0:
        return F.floor(x).cast("string")
    units = F.round(x * 10 ** places).cast("bigint")
    return F.concat((units / 10 ** places).cast("bigint").cast("string"), F.lit("."), F.lpad((units % 10 ** places).cast("string"), places, "0"))


def filled(text: str) -> Column:
    """A text whose placeholders take the values of the row; null where one is missing."""
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(text):
        value = F.col(m[1])
        parts += [F.lit(text[at:m.start()]), F.round(value * 100).cast("bigint").cast("string") if m[2] == "%" else fixed_point(value, int(m[2] or 0))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def chain_points(chain: Chain, side: str, role: str) -> Column:
    """Text of the first firing rule of a chain if it speaks for `side`, else null."""
    mine = F.col(role) == chain.role if chain.role else F.lit(True)
    out = F.lit(None).cast("string")
    for rule in reversed(chain.rules):
        fires = is_true(mine)
        for t in rule.tests:
            fires = fires & is_true(OPERATORS[t.op](F.col(t.column), F.lit(t.value)))
        out = F.when(fires, filled(rule.text) if rule.side == side else F.lit(None).cast("string")).otherwise(out)
    return out


def fired_points(chains: Sequence[Chain], side: str, role: str) -> Column:
    """The points that the chains give to one side, in their order."""
    relevant = [c for c in chains if any(r.side == side for r in c.rules)]
    return F.filter(F.array(*[chain_points(c, side, role) for c in relevant]), lambda p: p.isNotNull())


def first_points(fired: Column, backup: Column, limit: int) -> Column:
    """The first `limit` points, of the backup where no rule fired, with capitals."""
    return F.transform(F.slice(F.when(F.size(fired) > 0, fired).otherwise(backup), 1, limit), capitalise_first)
