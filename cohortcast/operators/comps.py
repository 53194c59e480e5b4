"""Nearest comparable entities among strictly earlier cohorts.

Exact k-nearest search by ring expansion. Pool rows lie in cells of a fixed grid over slot and leading features; a
query meets its own cell first, then rings of cells around it in an equi-join, and leaves once no cell further out can
hold a nearer row than its k-th. The pool of a cell is held as arrays in a task, in blocks of rows close together, and the
queries stream past it, each meeting only the blocks that may hold a nearer row. A cell holds the pool of its queries' whole
slot window, and all weightings and windows that are asked for are served by the same visit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators.grouped import attach, top_per_group
from cohortcast.operators.ranks import prefix_counts
from cohortcast.operators.stats import cohort_years, for_cohorts, past_covariance, past_scale
from cohortcast.session import materialize


@dataclass(frozen=True)
class CompSpec:
    """What makes two entities comparable, and how many comparables to keep."""

    categories: Mapping[str, Sequence[str]]
    weights: Mapping[str, float] = field(default_factory=dict)
    k: int = presets.COMP_K
    window: int = presets.COMP_WINDOW
    min_pool: int = presets.COMP_MIN_POOL
    covariance: bool = True
    strict: bool = True
    ids: str = "entity_id"
    block: str = "position"
    year: str = "cohort_year"
    slot: str = "slot"
    rows_per_cell: int = 1_000_000
    rows_per_block: int = 128

    @property
    def axes(self) -> list[str]:
        """The features that the grid is laid over."""
        return self.features[:2]

    @property
    def features(self) -> list[str]:
        return [f for fs in self.categories.values() for f in fs]

    @property
    def layout(self) -> list[tuple[int, int, float]]:
        """(start, stop, weight) of each category in the feature array."""
        out, at = [], 0
        for name, fs in self.categories.items():
            out.append((at, at + len(fs), float(self.weights.get(name, 1.0))))
            at += len(fs)
        return out


# ── parameters per (block, cohort) ──────────────────────────────────────────


def _inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse of a covariance pulled a tenth of the way to its diagonal; diagonal if singular."""
    d = np.diag(np.diag(cov))
    reg = np.nan_to_num(0.9 * cov + 0.1 * d)
    diag = np.diag(reg).copy()
    diag[diag == 0] = 1.0
    np.fill_diagonal(reg, diag)
    try:
        return np.linalg.inv(reg)
    except np.linalg.LinAlgError:
        return np.diag(1.0 / diag)


def search_params(pool: DataFrame, cohorts: Column, spec: CompSpec) -> DataFrame:
    """One row per (block, cohort): pool size, feature scales, the inverse covariance of each
    category (flattened, in scaled units) and its least eigenvalue, all from earlier cohorts."""
    feats, block = spec.features, spec.block
    per_year = pool.groupBy(block, spec.year).agg(F.count("*").alias("n"))
    sizes = for_cohorts(per_year, spec.year, cohorts, spec.strict).groupBy(block, "cohort").agg(F.sum("n").alias("n_pool"))
    scale = past_scale(pool, cohorts, [block], spec.year, feats, strict=spec.strict)
    wide = scale.groupBy(block, "cohort").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("feature") == f, F.col("scale"))), F.lit(1.0)) for f in feats]).alias("scale"))
    out = attach(sizes, wide, [block, "cohort"])
    if not spec.covariance:
        eye = F.array(*[F.array(*[F.lit(float(r == c)) for r in range(b - a) for c in range(b - a)])
                        for a, b, _ in spec.layout])
        ones = F.array(*[F.lit(1.0) for _ in spec.layout])
        return materialize(out.withColumns({"inv": eye, "least": ones}), "comp-params")
    base = pool.select(block, F.col(spec.year), *[F.col(f).cast("double").alias(f) for f in feats])
    # one empty row per (block, cohort) makes a cohort visible that holds no pool rows of its own
    frame = for_cohorts(pool.select(block).distinct(), spec.year, cohorts, False).withColumnRenamed("cohort", spec.year)
    cov = past_covariance(base.unionByName(frame, allowMissingColumns=True), [block], spec.year, feats, spec.strict)
    cells = cov.groupBy(block, "cohort").agg(F.collect_list(F.struct("i", "j", "cov")).alias("cells"))
    layout, n = spec.layout, len(feats)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            invs, least = [], []
            for cells_, scale_ in zip(pdf["cells"], pdf["scale"]):
                full = np.full((n, n), np.nan)
                if cells_ is not None:
                    for c in cells_:
                        full[c["i"], c["j"]] = full[c["j"], c["i"]] = np.nan if c["cov"] is None else c["cov"]
                s = np.ones(n) if scale_ is None else np.asarray(scale_, dtype=float)
                full = full / np.outer(s, s)
                found = [_inverse(full[a:b, a:b]) for a, b, _ in layout]
                invs.append([m.ravel().tolist() for m in found])
                least.append([max(0.0, float(np.linalg.eigvalsh((m + m.T) / 2)[0])) for m in found])
            yield pdf.drop(columns=["cells"]).assign(inv=invs, least=least)

    ready = attach(out, cells, [block, "cohort"])
    kinds = dict(ready.dtypes)
    schema = f"{block} {kinds[block]}, cohort {kinds['cohort']}, n_pool bigint, scale array<double>, inv array<array<double>>, least array<double>"
    ordered = ready.select(block, "cohort", "n_pool", "scale", "cells")
    return materialize(ordered.mapInPandas(invert, schema), "comp-params")


def pair_distance(q: str, p: str, scale: str, inv: str, spec: CompSpec, weights: Column | None = None) -> Column:
    """Distance of two feature arrays as a column expression, for an explicit list of pairs."""
    diffs = [(F.get(q, F.lit(i)) - F.get(p, F.lit(i))) / F.get(scale, F.lit(i)) for i in range(len(spec.features))]
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, (a, b, w) in enumerate(spec.layout):
        size = b - a
        w = F.lit(w) if weights is None else weights[c]
        frac = F.lit(0.0)
        for i in range(a, b):
            frac = frac + diffs[i].isNotNull().cast("double")
        frac = frac / size
        quad = F.lit(0.0)
        for i in range(size):
            for j in range(size):
                s = F.get(F.get(inv, F.lit(c)), F.lit(i * size + j))
                quad = quad + F.coalesce(s * diffs[a + i] * diffs[a + j], F.lit(0.0))
        total = total + w * frac * F.greatest(quad, F.lit(0.0))
        weight = weight + w * frac
    return F.coalesce(F.sqrt(F.try_divide(total, weight)), F.lit(float("inf")))


# ── nearest by slot alone ───────────────────────────────────────────────────


def nearest_by_slot(queries: DataFrame, pool: DataFrame, cohorts: Column, spec: CompSpec, n: int) -> DataFrame:
    """For each distinct (block, cohort, slot) of the queries the `n` pool ids nearest in slot.

    The answer depends on the key only, at most the first `n` ids of a slot can be in it, and they lie
    within the `n` occupied slots on either side: a bounded number of candidates per key.
    """
    block, slot, ids = spec.block, spec.slot, spec.ids
    keys = queries.select(block, F.col(spec.year).alias("cohort"), slot).distinct()
    heads = top_per_group(pool.select(block, spec.year, slot, F.col(ids).alias("comp_id")),
                          [block, spec.year, slot], [F.col("comp_id").asc()], n)
    past = top_per_group(for_cohorts(heads, spec.year, cohorts, spec.strict).drop(spec.year),
                         [block, "cohort", slot], [F.col("comp_id").asc()], n)
    past = materialize(past, "slot-heads")
    marked = (past.select(block, "cohort", slot).distinct().withColumn("one", F.lit(1).cast("bigint"))
              .unionByName(keys.withColumn("one", F.lit(0).cast("bigint")))
              .groupBy(block, "cohort", slot).agg(F.sum("one").alias("one")))
    index = prefix_counts(marked, [block, "cohort"], slot, ["one"]).select(
        block, "cohort", slot, "one", F.col("one_below").alias("at"))
    occupied = index.where("one > 0").select(block, "cohort", F.col(slot).alias("comp_slot"), "at")
    around = attach(keys, index.select(block, "cohort", slot, F.col("at").alias("own")), [block, "cohort", slot])
    asked = around.select(block, "cohort", slot, F.explode(
        F.sequence(F.greatest(F.col("own") - n, F.lit(0)), F.col("own") + n)).alias("at"))
    slots = asked.join(occupied, [block, "cohort", "at"]).drop("at")
    rows = slots.join(past.withColumnRenamed(slot, "comp_slot"), [block, "cohort", "comp_slot"])
    rows = rows.withColumn("slot_gap", F.abs(F.col(slot) - F.col("comp_slot")))
    return top_per_group(rows, [block, "cohort", slot], [F.col("slot_gap").asc(), F.col("comp_id").asc()], n,
                         rank_col="slot_rank")


def distances_of(pairs: DataFrame, queries: DataFrame, pool: DataFrame, params: DataFrame, spec: CompSpec,
                 payload: Sequence[str]) -> DataFrame:
    """Distances of given (query id, comp_id) pairs, with the payload columns of the comparable; under the weights of `__variant` where `pairs` has that."""
    feats = F.array(*[F.col(f).cast("double") for f in spec.features])
    left = queries.select(spec.ids, spec.block, F.col(spec.year).alias("cohort"), feats.alias("__q"))
    right = pool.select(F.col(spec.ids).alias("comp_id"), *payload, feats.alias("__p"))
    given = [c for c in ("variant", "__variant") if c in pairs.columns]
    weights = F.col("__variant.weights") if given else None
    rows = attach(pairs.select(spec.ids, "comp_id", *given).join(left, spec.ids).join(right, "comp_id"),
                  params.select(spec.block, "cohort", "scale", "inv"), [spec.block, "cohort"])
    return rows.select(spec.ids, *given[:1], "comp_id", F.round(pair_distance("__q", "__p", "scale", "inv", spec, weights), 9).alias("distance"), *payload)


# ── cells and rings ─────────────────────────────────────────────────────────


def _grid(pool: DataFrame, spec: CompSpec) -> DataFrame:
    """Per block: cells along each axis, and where the cells of each axis begin and how wide they are.

    Four deviations around the mean are cut evenly, so that an average cell of the block holds about `rows_per_cell` rows; the
    outermost cells are open. The number of cells follows the rows at every size.
    """
    axes = spec.axes
    stats = pool.groupBy(spec.block).agg(F.count("*").alias("__n"), *[
        x for f in axes for x in (F.avg(F.col(f).cast("double")).alias(f"__m_{f}"), F.stddev_pop(F.col(f).cast("double")).alias(f"__s_{f}"))])
    cells = F.greatest(F.lit(1), F.floor(F.pow(F.col("__n") / spec.rows_per_cell, F.lit(1.0 / len(axes)))).cast("int"))
    stats = stats.withColumn("__g", cells)
    return stats.select(spec.block, "__g", *[F.struct(
        (F.col(f"__m_{f}") - 2 * F.col(f"__s_{f}")).alias("start"),
        F.when(F.col(f"__s_{f}") > 0, 4 * F.col(f"__s_{f}") / F.col("__g")).otherwise(1.0).alias("width")).alias(f"__a{i}") for i, f in enumerate(axes)])


def _place(feature: str, axis: str) -> Column:
    """The cell of a value on an axis, -1 for none; an axis that is not cut has one cell for all."""
    at = F.floor((F.col(feature).cast("double") - F.col(f"{axis}.start")) / F.col(f"{axis}.width")).cast("int")
    return F.when(at.isNotNull() | (F.col("__g") == 1), F.greatest(F.lit(0), F.least(F.col("__g") - 1, at))).otherwise(-1)


def _steps(i: int, outer: int) -> Column:
    """(c, d, low) of the places of axis `i` up to `outer` cells away: number, cells away, least distance of a row there."""
    at, start, width, x = F.col(f"__c{i}"), F.col(f"__a{i}.start"), F.col(f"__a{i}.width"), F.col(f"__x{i}")
    known = F.sequence(F.greatest(at - outer, F.lit(0)), F.least(at + outer, F.col("__g") - 1))
    places = F.concat(F.array(F.lit(-1)), F.when(at < 0, F.sequence(F.lit(0), F.col("__g") - 1)).otherwise(known))

    def step(c: Column) -> Column:
        gap = F.greatest(F.when(c > at, start + c * width - x), F.when(c < at, x - (start + (c + 1) * width)), F.lit(0.0))
        open_ = (c < 0) | (at < 0)
        return F.struct(c.alias("c"), F.when(open_, 0).otherwise(F.abs(c - at)).alias("d"),
                        F.when(open_, 0.0).otherwise(gap * F.col("__least")[i]).alias("low"))

    return F.filter(F.transform(places, step), lambda s: s["low"] <= F.col("__worst") * (1 + 1e-9) + 1e-8)


def _ring(inner: int, outer: int, spec: CompSpec) -> Column:
    """Grid cells (c0, c1) whose distance in cells from the query's own is above `inner` and up to `outer`, unless too far for its k-th row.

    A place without a value, on either side, is next to every place of its axis.
    """
    steps = [_steps(i, outer) for i in range(len(spec.axes))]
    if len(steps) == 1:
        return F.filter(F.transform(steps[0], lambda s: F.struct(F.array(s["c"]).alias("c"), s["d"].alias("d"))), lambda s: (s["d"] > inner) & (s["d"] <= outer))
    both = F.flatten(F.transform(steps[0], lambda a: F.transform(steps[1], lambda b: F.struct(
        F.array(a["c"], b["c"]).alias("c"), F.greatest(a["d"], b["d"]).alias("d")))))
    return F.filter(both, lambda s: (s["d"] > inner) & (s["d"] <= outer))


def _beyond(reach: int, spec: CompSpec) -> Column:
    """Least distance of a row further out than `reach` cells; infinite where the grid ends."""
    sides = []
    for i in range(len(spec.axes)):
        at, x, start, width = F.col(f"__c{i}"), F.col(f"__x{i}"), F.col(f"__a{i}.start"), F.col(f"__a{i}.width")
        left = F.when((at >= 0) & (at - reach - 1 >= 0), x - (start + (at - reach) * width))
        right = F.when((at >= 0) & (at + reach + 1 <= F.col("__g") - 1), start + (at + reach + 1) * width - x)
        sides += [F.when(side.isNotNull(), F.greatest(side, F.lit(0.0)) * F.col("__least")[i]).otherwise(float("inf")) for side in (left, right)]
    return F.least(*sides)


def _least_factor(spec: CompSpec, settings: Sequence[tuple]) -> Column:
    """Per axis: a factor that turns a difference in the feature into a lower bound of the distance, under every weighting of `settings`.

    A category's form is at least its least eigenvalue times the squared difference, and the mean over the
    categories at least the smallest share of the weight that the category can have.
    """
    out = []
    for i in range(len(spec.axes)):
        c, (a, b, _) = next((c, part) for c, part in enumerate(spec.layout) if part[0] <= i < part[1])
        shares = []
        for weights, _ in settings:
            least = weights[c] / (b - a)
            whole = least + sum(weights) - weights[c]
            shares.append(least / whole if whole else 0.0)
        out.append(F.sqrt(min(shares) * F.get("__low", F.lit(c))) / F.get("scale", F.lit(i)))
    return F.array(*out)


def _distances(qm: np.ndarray, pm: np.ndarray, layout, invs: Sequence[np.ndarray], weights: Sequence[float]) -> np.ndarray:
    """Distances of all rows of `qm` to all of `pm`, in scaled features."""
    total, weight = np.zeros((len(qm), len(pm))), np.zeros((len(qm), len(pm)))
    for (a, b, _), inv, w in zip(layout, invs, weights):
        size = b - a
        inv = inv.reshape(size, size)
        diffs = [qm[:, i][:, None] - pm[:, i][None, :] for i in range(a, b)]
        frac = sum((~np.isnan(d)).astype(float) for d in diffs) / size
        diffs = [np.nan_to_num(d) for d in diffs]
        quad = np.zeros(total.shape)
        for i in range(size):
            for j in range(size):
                if inv[i, j] != 0.0:
                    quad += inv[i, j] * diffs[i] * diffs[j]
        total += w * frac * np.maximum(quad, 0.0)
        weight += w * frac
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight > 0, np.sqrt(total / weight), np.inf).round(9)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix, nulls as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _leaves(z: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of `z`, ascending, in groups of up to `size` that lie close together, by halving along the widest axis; equal rows in their order."""
    left, out = [np.arange(len(z))], []
    while left:
        part = left.pop()
        if len(part) <= size:
            out.append(part)
            continue
        here = z[part]
        half = len(part) // 2
        values = here[:, int(np.argmax(np.ptp(here, axis=0)))]
        middle = np.partition(values, half)[half]
        first = values < middle
        first[np.flatnonzero(values == middle)[:half - int(first.sum())]] = True
        left += [part[~first], part[first]]
    return out


@dataclass
class _Measure:
    """The squared distances over the features that two rows share: per category the columns and their form, and for each distinct
    weighting the categories' shares of the weight and the variants that use it, by window."""

    parts: list[tuple[list[int], np.ndarray]]
    shares: np.ndarray
    users: list[dict[float, list[int]]]

    def forms(self, qm: np.ndarray, columns: Sequence[np.ndarray], blocks: np.ndarray) -> list[np.ndarray]:
        """Per category, each query against the rows of its own blocks."""
        out = []
        for own, inv in self.parts:
            diffs = [qm[:, c][:, None] - columns[c][blocks].reshape(len(qm), -1) for c in own]
            quad = 0.0
            for i in range(len(own)):
                for j in range(i, len(own)):
                    factor = inv[i, i] if i == j else inv[i, j] + inv[j, i]
                    if factor != 0.0:
                        quad = quad + factor * (diffs[i] * diffs[j])
            out.append(np.maximum(quad, 0.0, out=np.zeros(diffs[0].shape)))
        return out

    def straight(self, m: np.ndarray) -> list[np.ndarray]:
        """Per category, coordinates whose plain distance is never above the form: equal to it, but for one that is not positive, which counts nothing."""
        out = []
        for own, inv in self.parts:
            values, vectors = np.linalg.eigh((inv + inv.T) / 2)
            out.append(m[:, own] @ vectors * np.sqrt(values) if values[0] >= 0 else np.zeros((len(m), 1)))
        return out

    def place(self, z: Sequence[np.ndarray]) -> np.ndarray:
        """One set of coordinates, to find rows that lie close together."""
        return np.hstack([part * np.sqrt(share) for part, share in zip(z, self.shares.mean(axis=0))])


def _measure(shared: np.ndarray, layout, invs: Sequence[np.ndarray], settings: Sequence[tuple]) -> tuple[_Measure | None, list[int]]:
    """The measure over the shared features, and the variants under which they carry no weight."""
    parts, fractions, at = [], [], []
    for c, ((a, b, _), inv) in enumerate(zip(layout, invs)):
        inside = [i for i in range(b - a) if shared[a + i]]
        if inside:
            parts.append(([a + i for i in inside], inv.reshape(b - a, b - a)[np.ix_(inside, inside)]))
            fractions.append(len(inside) / (b - a))
            at.append(c)
    users, without = {}, []
    for v, (weights, window) in enumerate(settings):
        own = [weights[c] * fraction for c, fraction in zip(at, fractions)]
        if sum(own) > 0:
            users.setdefault(tuple(x / sum(own) for x in own), {}).setdefault(window, []).append(v)
        else:
            without.append(v)
    return (_Measure(parts, np.array(list(users)), list(users.values())) if users else None), without


class _Keys:
    """The nearest of each query and variant as whole numbers: the rounded distance, then the row. Needs distances that leave room for the row."""

    none = np.iinfo(np.int64).max

    def __init__(self, far: np.ndarray, k: int, rows: int):
        self.k, self.bits, self.room = k, int(rows).bit_length(), self.room_beside(rows)
        self.held = np.full((*far.shape, k), self.none)
        self.far = np.full(far.shape, self.none)
        some = far < self.room
        self.far[some] = (np.rint(far[some] * 1e9).astype(np.int64) + 1) << self.bits

    @staticmethod
    def room_beside(rows: int) -> float:
        """The distance up to which there is room for numbers of as many rows."""
        return 2.0 ** (62 - int(rows).bit_length()) / 1e9

    def of(self, distance: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (np.rint(distance * 1e9).astype(np.int64) << self.bits) | rows

    def least(self, squared: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What no row of a block can be below, rounding included."""
        return self.of(np.clip(np.sqrt(squared) * (1 - 1e-9) - 1e-8, 0.0, self.room), first)

    def worst(self, some: np.ndarray) -> np.ndarray:
        return np.minimum(self.held[some, :, self.k - 1], self.far[some])

    def offer(self, some: np.ndarray, variants: list[int], keys: np.ndarray, inside: np.ndarray) -> None:
        keys = np.where(inside, keys, self.none)
        hit = np.flatnonzero(keys.min(axis=1) < self.held[some][:, variants, self.k - 1].max(axis=1))
        if len(hit):
            keys, at = keys[hit], np.ix_(some[hit], variants)
            if keys.shape[1] > self.k:
                keys = np.partition(keys, self.k - 1, axis=1)[:, :self.k]
            both = np.concatenate([self.held[at], np.repeat(keys[:, None, :], len(variants), axis=1)], axis=2)
            self.held[at] = np.partition(both, self.k - 1, axis=2)[:, :, :self.k]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows, -1 for none, and distances, in order."""
        held = np.sort(self.held, axis=2)
        found = held < self.none
        return np.where(found, held & ((1 << self.bits) - 1), -1), np.where(found, (held >> self.bits) / 1e9, np.inf)


class _Pairs:
    """The same as pairs of distance and row, for distances of any size; slower."""

    none = np.inf

    def __init__(self, far: np.ndarray, k: int):
        self.k, self.far = k, far * (1 + 1e-9) + 1e-8
        self.distance = np.full((*far.shape, k), np.inf)
        self.row = np.full((*far.shape, k), np.iinfo(np.int64).max)

    def of(self, distance: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distance.round(9), rows

    def least(self, squared: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(np.sqrt(squared) * (1 - 1e-9) - 1e-8, 0.0)

    def worst(self, some: np.ndarray) -> np.ndarray:
        return np.minimum(self.distance[some, :, self.k - 1], self.far[some])

    def offer(self, some: np.ndarray, variants: list[int], keys: tuple[np.ndarray, np.ndarray], inside: np.ndarray) -> None:
        distance, rows = keys
        inside = inside & ~np.isnan(distance)
        near = inside & (distance <= self.distance[some][:, variants, self.k - 1].max(axis=1)[:, None])
        hit = np.flatnonzero(near.any(axis=1))
        if len(hit):
            distance = np.where(near[hit], distance[hit], np.inf)
            row = np.where(near[hit], np.broadcast_to(rows, near.shape)[hit], np.iinfo(np.int64).max)
            for v in variants:
                d = np.concatenate([self.distance[some[hit], v], distance], axis=1)
                r = np.concatenate([self.row[some[hit], v], row], axis=1)
                order = np.lexsort((r, d), axis=1)[:, :self.k]
                self.distance[some[hit], v], self.row[some[hit], v] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.row < np.iinfo(np.int64).max, self.row, -1), self.distance


class _Cell:
    """The pool rows of a cell in order of their ids, told apart by which features they have."""

    def __init__(self, ids: np.ndarray, years: np.ndarray, slots: np.ndarray, features: np.ndarray, few: int):
        self.ids, self.years, self.slots, self.features = ids, years, slots, features
        kinds, kind = np.unique(np.packbits(~np.isnan(features), axis=1), axis=0, return_inverse=True) if features.shape[1] > 62 else np.unique(
            ~np.isnan(features) @ (1 << np.arange(features.shape[1])), return_inverse=True)
        kind = kind.reshape(-1)
        infinite = np.isinf(features).any(axis=1)
        self.finite = not infinite.any()
        kind[infinite] = -1
        groups = [np.flatnonzero(kind == i) for i in range(len(kinds))]
        self.kinds = [(~np.isnan(features[rows[0]]), rows) for rows in groups if len(rows) >= few]
        self.rest = np.sort(np.concatenate([np.flatnonzero(infinite), *[rows for rows in groups if len(rows) < few]]))
        with np.errstate(invalid="ignore"):
            self.low = np.fmin.reduce(features, axis=0, initial=np.inf)
            self.high = np.fmax.reduce(features, axis=0, initial=-np.inf)
        self.laid: dict = {}
        self.laid_for = None


def _search(spec: CompSpec, settings: Sequence[tuple]):
    """Over rows sorted by cell, pool before queries and pool by id: each query's `k` nearest in the cell under each of `settings`
    (weights per category, window), as one list of lists.

    Pool rows with the same features known lie in blocks of rows close together, under the measure of the features that they share
    with a query; a query meets its nearest blocks first, until no further one can hold a nearer row. A row that is met is
    measured once per category, and all weightings and windows are read off that.
    """
    layout, n_features, at_once, k = spec.layout, len(spec.features), 1_000_000, spec.k
    weightings = {}
    for v, (weights, window) in enumerate(settings):
        weightings.setdefault(weights, {}).setdefault(window, []).append(v)

    def lay(cell: _Cell, rows: np.ndarray, kind: int, scale, measure: _Measure):
        """Blocks of the rows: their numbers, first number, scaled features, slots and bounds per category; once per measure."""
        if kind not in cell.laid:
            scaled = cell.features[rows] / scale
            z = measure.straight(scaled)
            leaves = _leaves(measure.place(z), spec.rows_per_block)
            starts, length = np.cumsum([0, *map(len, leaves)])[:-1], max(map(len, leaves))
            order = np.concatenate(leaves)
            at = np.array([np.resize(leaf, length) for leaf in leaves])  # short blocks are filled up with rows that lie out of every window
            pad = np.arange(length) >= np.array([len(leaf) for leaf in leaves])[:, None]
            slots = np.where(pad, np.inf, cell.slots[rows[at]])
            bounds = [(np.minimum.reduceat(part[order], starts), np.maximum.reduceat(part[order], starts)) for part in z]
            cell.laid[kind] = rows[at], rows[at[:, 0]], [scaled[:, c][at] for c in range(n_features)], slots, bounds
        return cell.laid[kind]

    def through_blocks(cell, laid, measure, lists, qm, qid, slot):
        rows, first, columns, slots, bounds = laid
        zq = measure.straight(qm)

        def meet(some, blocks, ok):
            """Queries against the rows of their own blocks."""
            met = rows[blocks].reshape(len(some), -1)
            gap = np.abs(slot[some][:, None, None] - slots[blocks])
            gap[~ok] = np.inf
            gap = gap.reshape(met.shape)
            if not spec.strict:
                gap[qid[some][:, None] == cell.ids[met]] = np.inf
            forms = measure.forms(qm[some], columns, blocks)
            inside = {window: gap <= window for window in {w for users in measure.users for w in users}}
            for shares, users in zip(measure.shares, measure.users):
                keys = lists.of(np.sqrt(sum(share * form for share, form in zip(shares, forms))), met)
                for window, variants in users.items():
                    lists.offer(some, variants, keys, inside[window])

        def least(low, high, first):
            """Per weighting, what rows of the blocks cannot be below, seen from queries between `low` and `high`."""
            gaps = [np.square(np.maximum(np.maximum(lo - h, l - hi), 0.0)).sum(axis=-1) for (lo, hi), l, h in zip(bounds_, low, high)]
            return [lists.least(sum(share * gap for share, gap in zip(shares, gaps)), first) for shares in measure.shares]

        def limits(some):
            worst = lists.worst(some)
            return [worst[:, [v for variants in users.values() for v in variants]].max(axis=1) for users in measure.users]

        for some in _leaves(measure.place(zq), 128):
            mine = [part[some] for part in zq]
            limit, seen = limits(some), np.zeros(0, int)
            bounds_ = bounds
            if max(x.max() for x in limit) == lists.none and len(rows) > 2:
                centre = [(part.min(axis=0) + part.max(axis=0)) / 2 for part in mine]
                seen = np.argpartition(np.min(least(centre, centre, first), axis=0), 1)[:2]
                meet(some, np.tile(seen, (len(some), 1)), np.ones((len(some), 2), bool))
                limit = limits(some)
            near = least([part.min(axis=0) for part in mine], [part.max(axis=0) for part in mine], first)
            near = np.flatnonzero(np.any([x <= y.max() for x, y in zip(near, limit)], axis=0))
            near = near[~np.isin(near, seen)]
            bounds_ = [(lo[near], hi[near]) for lo, hi in bounds]
            low = least([part[:, None, :] for part in mine], [part[:, None, :] for part in mine], first[near])
            take = 1
            while len(near):
                score = np.min([np.where(x <= y[:, None], x, lists.none) for x, y in zip(low, limit)], axis=0)
                open_ = np.flatnonzero(score.min(axis=1) < lists.none)
                if not len(open_):
                    break
                take = min(2 * take, 8, len(near))
                score = score[open_]
                pick = np.argpartition(score, take - 1, axis=1)[:, :take] if take < len(near) else np.tile(np.arange(take), (len(open_), 1))
                meet(some[open_], near[pick], np.take_along_axis(score, pick, axis=1) < lists.none)
                for x in low:
                    x[open_[:, None], pick] = lists.none  # not open again
                limit = limits(some)

    def through_rest(cell, may, lists, qm, scale, invs, qid, slot, finite):
        """The same for rows of rare kinds, one by one."""
        pf = cell.features[may] / scale
        step = max(1, at_once // max(1, len(may)))
        for s in range(0, len(qm) if len(may) else 0, step):
            some = np.arange(s, min(s + step, len(qm)))
            gap = np.abs(slot[some][:, None] - cell.slots[may][None, :])
            if not spec.strict:
                gap[qid[some][:, None] == cell.ids[may][None, :]] = np.inf
            for weights, users in weightings.items():
                distance = _distances(qm[some], pf, layout, invs, weights)
                ok = np.isfinite(distance) if finite else np.ones(distance.shape, bool)
                keys = lists.of(np.where(ok, distance, 0.0), np.broadcast_to(may, distance.shape))
                for window, variants in users.items():
                    lists.offer(some, variants, keys, ok & (gap <= window))

    def unlike(cell, may, query: int, qid, slot, window):
        """The first `k` rows in the window of one query, for rows that share nothing with it."""
        taken, size = np.zeros(0, int), 1024
        for s in range(0, len(may), size):
            part = may[s:s + size]
            ok = np.abs(cell.slots[part] - slot[query]) <= window
            if not spec.strict:
                ok &= cell.ids[part] != qid[query]
            taken = np.concatenate([taken, part[ok]])[:k]
            if len(taken) == k:
                break
        return taken

    def nearest(cell: _Cell, year: int, scale, invs, qid, slot, qf, far):
        """Rows, -1 for none, and distances of the nearest of queries that know the same features, per query and variant."""
        known = ~np.isnan(qf[0])
        if cell.laid_for != (year, known.tobytes()):
            cell.laid, cell.laid_for = {}, (year, known.tobytes())
        allowed = cell.years < year if spec.strict else np.ones(len(cell.ids), bool)
        qm, plain = qf / scale, not np.isinf(qf).any()
        with np.errstate(invalid="ignore"):
            span = np.nan_to_num(np.where(known, (np.fmax(qf.max(axis=0), cell.high) - np.fmin(qf.min(axis=0), cell.low)) / scale, 0.0), nan=0.0, posinf=0.0, neginf=0.0)
        most = max(float(np.abs(inv).reshape(b - a, b - a).dot(span[a:b]).dot(span[a:b])) for (a, b, _), inv in zip(layout, invs))
        keyed = plain and cell.finite and np.sqrt(most) < _Keys.room_beside(len(cell.ids))
        lists = _Keys(far, k, len(cell.ids)) if keyed else _Pairs(far, k)
        may = np.flatnonzero(allowed) if not plain else cell.rest[allowed[cell.rest]]
        through_rest(cell, may, lists, qm, scale, invs, qid, slot, keyed)
        bare: dict = {}
        if keyed:
            kinds, kind = np.unique(~np.isnan(cell.features[may]), axis=0, return_inverse=True)
            for i, has in enumerate(kinds):
                rows = may[kind.reshape(-1) == i]
                for v in _measure(has & known, layout, invs, settings)[1]:
                    bare.setdefault(v, []).append(rows)
        # rows that share few features first: they tend to be nearest
        for kind in sorted(range(len(cell.kinds)) if plain else [], key=lambda i: int((cell.kinds[i][0] & known).sum())):
            shared, rows = cell.kinds[kind][0] & known, cell.kinds[kind][1]
            measure, without = _measure(shared, layout, invs, settings)
            rows = rows[allowed[rows]]
            if len(rows):
                for v in without:
                    bare.setdefault(v, []).append(rows)
                if measure is not None:
                    through_blocks(cell, lay(cell, rows, kind, scale, measure), measure, lists, qm, qid, slot)
        row, distance = lists.result()
        joined: dict = {}
        for v, parts in bare.items():
            held = np.isfinite(distance[:, v]).sum(axis=1)
            for q in np.flatnonzero((held < k) & np.isinf(far[:, v])):
                which = tuple(map(id, parts))
                if which not in joined:
                    joined[which] = np.sort(np.concatenate(parts))
                more = unlike(cell, joined[which], q, qid, slot, settings[v][1])
                more = np.sort(np.concatenate([row[q, v, held[q]:][row[q, v, held[q]:] >= 0], more]))[:k - held[q]]
                row[q, v, held[q]:held[q] + len(more)] = more
        return row, distance

    def compare(cell: _Cell, query: pa.RecordBatch):
        qid, cohort = query.column("id").to_numpy(), query.column("year").to_numpy()
        slot, qf = query.column("slot").to_numpy(), _numbers(query.column("f"), n_features)
        far = query.column("far")
        far = np.full((len(qid), len(settings)), np.inf) if far.null_count else _numbers(far, len(settings))
        same = np.column_stack([cohort, np.isnan(qf), np.isinf(qf).any(axis=1)])
        _, group = np.unique(same, axis=0, return_inverse=True)
        order = np.argsort(group.reshape(-1), kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(group.reshape(-1)[order])) + 1):
            first = int(mine[0])
            scale = np.array(query.column("scale")[first].as_py(), float)
            invs = [np.array(m, float) for m in query.column("inv")[first].as_py()]
            yield mine, *nearest(cell, int(cohort[first]), scale, invs, qid[mine], slot[mine], qf[mine], far[mine])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held, extra = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(cells)]
            for start, end in zip(edges, edges[1:]):
                if cells[start] != cell:
                    cell, parts, held, extra = cells[start], [], None, None
                part = batch.slice(start, end - start)
                if not side[start]:
                    parts.append((*(part.column(c).to_numpy() for c in ("id", "year", "slot")), _numbers(part.column("f"), n_features), part.column("payload")))
                    continue
                if held is None and parts:
                    *numbers, payloads = zip(*parts)
                    parts, held, extra = [], _Cell(*map(np.concatenate, numbers), max(1, spec.rows_per_block // 4)), pa.concat_arrays(payloads)
                if held is None:
                    continue
                for mine, row, distance in compare(held, part):
                    kept = row >= 0
                    taken = row[kept]
                    payload = [extra.field(i).take(pa.array(taken)) for i in range(1, extra.type.num_fields)]
                    comps = pa.StructArray.from_arrays([pa.array(held.ids[taken]), pa.array(distance[kept]), *payload],
                                                       ["comp_id", "distance", *[extra.type.field(i).name for i in range(1, extra.type.num_fields)]])
                    ends = np.concatenate([[0], np.cumsum(kept.sum(axis=2).reshape(-1))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), comps)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(lists) + 1, len(settings), dtype=np.int32)), lists)
                    at = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("again").take(at), part.column("own").take(at), lists],
                                                     names=["qid", "again", "own", "lists"])
    return run


@dataclass(frozen=True)
class CompIndex:
    """A pool laid out for the search: its rows with their places in the grid, how many there are per place and slot, the grid, and the pool's own columns."""

    rows: DataFrame
    sizes: DataFrame
    grid: DataFrame
    pool: DataFrame

    def save(self, path: str) -> None:
        """Write the tables; the rows in order of their places, so that files hold whole cells where they can."""
        key = [c for c in self.rows.columns if c.startswith("__")]
        self.rows.repartition(*key).sortWithinPartitions(*key, "slot", "id").write.mode("errorifexists").parquet(f"{path}/rows")
        for name in ("sizes", "grid", "pool"):
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> CompIndex:
    return CompIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("rows", "sizes", "grid", "pool")])


def _place_key(spec: CompSpec) -> list[str]:
    return ["__b", *[f"__c{i}" for i in range(len(spec.axes))]]


def index_of(pool: DataFrame, spec: CompSpec, payload: Sequence[str] = ()) -> CompIndex:
    """The index of a pool. It holds no slot cells: those follow the widest window that is asked for."""
    ids, block, year, slot = spec.ids, spec.block, spec.year, spec.slot
    grid = materialize(_grid(pool, spec), "comp-grid")
    rows = attach(pool, grid, [block], "inner").where(F.col(slot).isNotNull()).select(
        F.col(block).alias("__b"), *[_place(f, f"__a{i}").alias(f"__c{i}") for i, f in enumerate(spec.axes)],
        F.col(ids).cast("bigint").alias("id"), F.col(year).cast("bigint").alias("year"), F.col(slot).cast("double").alias("slot"),
        F.array(*[F.col(f).cast("double") for f in spec.features]).alias("f"), F.struct(F.lit(0).alias("none"), *payload).alias("payload"))
    sizes = materialize(rows.groupBy(*_place_key(spec), F.floor("slot").cast("bigint").alias("at")).agg(F.count("*").alias("n")), "comp-sizes")
    return CompIndex(rows, sizes, grid, pool.select(*dict.fromkeys([ids, block, year, slot, *spec.features, *payload])))


def nearest_comps(queries: DataFrame, pool: DataFrame, spec: CompSpec, payload: Sequence[str] = (),
                  params: DataFrame | None = None, variants: Column | None = None, index: CompIndex | None = None,
                  beside: Sequence[str] | None = None) -> DataFrame:
    """The `k` nearest pool rows of each query within its slot window, or among the `3k` nearest slots
    where the window holds fewer than `k`; ranked, with distances and payload columns.

    Queries whose earlier pool is smaller than `min_pool` get no rows. `queries` and `pool` are read
    several times: pass written tables (`materialize`) rather than long plans. Ids and years are whole numbers.

    `variants`, an array of (weights per category, window) that is the same for all queries, has every query searched under each of them
    at once, and the column `variant` tells their results apart. `index` is one of this pool, for instance a stored one.

    With `beside`, columns of the query, the result is one row per query and variant instead: these columns, the place of the variant
    in `variants`, and the array `comps` in rank order.
    """
    own = F.array(F.struct(F.array(*[F.lit(w) for _, _, w in spec.layout]).alias("weights"), F.lit(spec.window).alias("window")))
    listed_variants = own if variants is None else variants
    spark = queries.sparkSession
    settings = [(tuple(map(float, v["weights"])), float(v["window"])) for v in spark.range(1).select(listed_variants.alias("v")).first()["v"]]
    widest = max(window for _, window in settings)
    ids, block, year, slot, k = spec.ids, spec.block, spec.year, spec.slot, spec.k
    cohorts = cohort_years(queries, year)
    params = params if params is not None else search_params(pool, cohorts, spec)
    index = index if index is not None else index_of(pool, spec, payload)
    grid = index.grid
    features = F.array(*[F.col(f).cast("double") for f in spec.features])
    places = [_place(f, f"__a{i}") for i, f in enumerate(spec.axes)]
    # a cell serves the queries of some slots: it holds the pool of these and of a window to either side, so a query meets all its rows at once
    width = max(1, int(widest) // 2 + 1)
    place_key = _place_key(spec)
    key = [*place_key, "__chunk"]

    def reaching(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor((low - widest) / width).cast("bigint"), F.floor((high + widest) / width).cast("bigint")))

    # the values that place a query are those of its features; rows that lack one are next to every place of the axis
    known = params.where(F.col("n_pool") >= spec.min_pool).select(block, F.col("cohort").alias(year), "scale", "inv", F.col("least").alias("__low"))
    placed = attach(attach(queries, known, [block, year], "inner"), grid, [block], "inner")
    asked = placed.where(F.col(slot).isNotNull()).select(
        F.col(ids).cast("bigint").alias("id"), F.col(year).cast("bigint").alias("year"), F.col(slot).cast("double").alias("slot"), features.alias("f"), "scale", "inv",
        F.struct(F.lit(0).alias("none"), *(beside or ())).alias("own"), F.floor(F.col(slot) / width).cast("bigint").alias("__chunk"),
        F.col(block).alias("__b"), "__g", _least_factor(spec, settings).alias("__least"), *[F.col(f"__a{i}") for i in range(len(places))], *[c.alias(f"__c{i}") for i, c in enumerate(places)],
        *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(spec.axes)], F.lit(float("inf")).alias("__worst"), F.lit(None).cast("array<double>").alias("far"))
    counts = index.sizes.select(*place_key, reaching(F.col("at"), F.col("at") + 1).alias("__chunk"), "n").groupBy(*key).agg(F.sum("n").alias("n"))
    kinds = {**dict(index.rows.dtypes), **dict(asked.select("own").dtypes)}
    columns = ["comp_id", "distance", *payload]
    comp = "struct<" + ", ".join(["comp_id: bigint", "distance: double", *[f"{c}: {t}" for c, t in index.rows.select("payload.*").dtypes[1:]]]) + ">"
    schema = f"qid bigint, again boolean, own {kinds['own']}, lists array<array<{comp}>>"

    def round_of(open_: DataFrame, inner: int, outer: int, whole: bool) -> DataFrame:
        """The lists of each visit to a cell; `again` where the id of the query has other lists too (always unless `whole`)."""
        visits = open_.withColumn("__ring", F.explode(_ring(inner, outer, spec)))
        visits = visits.withColumns({f"__c{i}": F.col("__ring.c")[i] for i in range(len(places))})
        met = attach(visits.groupBy(*key).agg(F.count("*").alias("__asked")), counts, key, "inner")
        met = met.withColumn("__parts", F.ceil(F.col("n") / max(8, spec.rows_per_cell)).cast("int"))
        # tasks in order of their work, the parts of a cell one after the other
        met = met.withColumn("__work", F.col("__asked") * len(settings) + F.col("n") / F.col("__parts"))
        in_order = Window.orderBy(F.col("__work").desc(), *key)
        cells = materialize(met.withColumn("__first", F.sum("__parts").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
                            .select(*key, "__parts", "__work", F.coalesce("__first", F.lit(0)).cast("int").alias("__first")), "comp-cells")
        n_parts, work = cells.agg(F.sum("__parts"), F.sum(F.col("__parts") * F.col("__work"))).first()
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_tasks = max(1, min(n_parts or 1, 4 * partitions, max(partitions, int((work or 0) // 10_000))))  # few where there is little to do
        visits = attach(visits, cells.drop("__work"), key, "inner").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        again = F.lit(True)
        if whole:
            twice = materialize(visits.groupBy("id").agg(F.count("*").alias("__n")).where("__n > 1").select("id", F.lit(True).alias("__again")), "comp-again")
            visits, again = visits.join(twice, "id", "left"), F.coalesce("__again", F.lit(False))
        visits = visits.select((F.col("__first") + F.col("__part")).alias("cell"), F.lit(1).alias("side"), "id", "year", "slot", "f", "scale", "inv",
                               F.lit(None).cast(kinds["payload"]).alias("payload"), again.alias("again"), "own", "far")
        rows = index.rows.withColumn("__chunk", reaching(F.col("slot"), F.col("slot")))
        rows = attach(rows, cells.drop("__work"), key, "inner").select(
            (F.col("__first") + F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).alias("cell"), F.lit(0).alias("side"), "id", "year", "slot", "f",
            F.lit(None).cast("array<double>").alias("scale"), F.lit(None).cast("array<array<double>>").alias("inv"), "payload",
            F.lit(None).cast("boolean").alias("again"), F.lit(None).cast(kinds["own"]).alias("own"), F.lit(None).cast("array<double>").alias("far"))
        # queries of the same measure together
        alike = [F.when(F.col("side") == 1, c) for c in (F.col("year"), F.transform("f", lambda x: x.isNull()))]
        both = rows.union(visits).repartitionById(n_tasks, F.col("cell") % n_tasks).sortWithinPartitions("cell", "side", *alike, "id")
        return both.mapInArrow(_search(spec, settings), schema)

    def rows_of(lists: DataFrame) -> DataFrame:
        return lists.select("qid", F.posexplode("lists").alias("variant", "comp")).select("qid", "variant", F.explode("comp").alias("comp"))

    def best_of(found: DataFrame) -> DataFrame:
        """The nearest of all the lists of an id."""
        best = top_per_group(found, ["qid", "variant"], [F.col("comp.distance").asc(), F.col("comp.comp_id").asc()], k, rank_col="__rank")
        listed = best.groupBy("qid", "variant").agg(F.array_sort(F.collect_list(F.struct("__rank", "comp"))).alias("__comps"))
        return listed.select("qid", "variant", F.transform("__comps", lambda x: x["comp"]).alias("comps"))

    most = grid.agg(F.max("__g")).first()[0] or 1
    found = materialize(round_of(asked, -1, 0, most == 1), "comps")
    lone = found.where(~F.col("again"))
    main = best_of(rows_of(found.where("again")))
    if most > 1:
        main = materialize(main, "comps")
    reach = 0
    while reach < most - 1:
        held = main.where(F.size("comps") >= k).groupBy(F.col("qid").alias("id")).agg(
            F.map_from_entries(F.collect_list(F.struct("variant", F.element_at("comps", -1)["distance"]))).alias("__held"))
        far = F.transform(F.sequence(F.lit(0), F.lit(len(settings) - 1)), lambda v: F.coalesce(F.try_element_at("__held", v), F.lit(float("inf"))))
        further = asked.drop("__worst", "far").join(held, "id", "left").withColumn("far", far).withColumn("__worst", F.array_max("far")).drop("__held")
        further = materialize(further.where((_beyond(reach, spec) <= F.col("__worst") * (1 + 1e-9) + 1e-8) & (_beyond(reach, spec) < float("inf"))), "comp-open")
        if not further.count():
            break
        more = round_of(further, reach, 2 * reach + 1, False)
        main = materialize(best_of(main.select("qid", "variant", F.explode("comps").alias("comp")).union(rows_of(more))), "comps")
        reach = 2 * reach + 1

    # fewer than k in the window: the nearest slots instead
    whole = main.where(F.size("comps") >= k)
    numbers = F.sequence(F.lit(0), F.lit(len(settings) - 1))
    every = queries.join(known.select(block, year), [block, year], "left_semi")
    others = every.select(F.col(ids).alias("qid")).join(lone.select("qid"), "qid", "left_anti").distinct().withColumn("variant", F.explode(numbers))
    lacking = others.join(whole, ["qid", "variant"], "left_anti").unionByName(
        lone.select("qid", F.posexplode("lists").alias("variant", "comps")).where(F.size("comps") < k).drop("comps"))
    short = materialize(every.join(lacking.withColumnRenamed("qid", ids), ids).withColumn("__variant", F.get(listed_variants, F.col("variant"))), "comp-short")
    near = nearest_by_slot(short, pool, cohorts, spec, 3 * k + (0 if spec.strict else 1))
    pairs = short.select(ids, "variant", "__variant", block, F.col(year).alias("cohort"), slot).join(near, [block, "cohort", slot])
    if not spec.strict:
        pairs = pairs.where(F.col("comp_id") != F.col(ids))
    once = short.drop("variant", "__variant").dropDuplicates([ids])
    wide = distances_of(pairs.select(ids, "comp_id", "variant", "__variant"), once, pool, params, spec, payload)
    wide = top_per_group(wide, [ids, "variant"], [F.col("distance").asc(), F.col("comp_id").asc()], k, rank_col="comp_rank")

    complete = lone.select("qid", "own", F.posexplode("lists").alias("variant", "comps")).where(F.size("comps") >= k)
    if beside is not None:
        listed = wide.groupBy(ids, "variant").agg(F.array_sort(F.collect_list(F.struct("comp_rank", F.struct(*columns).alias("comp")))).alias("comps"))
        joined = whole.select(F.col("qid").alias(ids), "variant", "comps").union(
            listed.withColumn("comps", F.transform("comps", lambda x: x["comp"])).select(ids, "variant", "comps"))
        joined = joined.join(queries.select(ids, *beside), ids).select(ids, *beside, "variant", "comps")
        return complete.select(F.col("qid").alias(ids), *[F.col(f"own.{c}").alias(c) for c in beside], "variant", "comps").union(joined)
    kept = complete.drop("own").unionByName(whole).select(F.col("qid").alias(ids), "variant", F.posexplode("comps").alias("__at", "comp"))
    kept = kept.select(ids, "variant", *[f"comp.{c}" for c in columns], (F.col("__at") + 1).alias("comp_rank"))
    out = kept.unionByName(wide.select(kept.columns))
    if variants is None:
        return out.drop("variant")
    return out.withColumn("variant", F.element_at(variants, F.col("variant") + 1))


# ── what the comparables say ────────────────────────────────────────────────


def similarity(bandwidth: float) -> Column:
    return F.exp(-F.col("distance") / bandwidth)


def comp_features(queries: DataFrame, comps: DataFrame, params: DataFrame, spec: CompSpec, outcome: str,
                  bandwidth: float = presets.COMP_BANDWIDTH, bust_below: float = presets.COMP_BUST_BELOW) -> DataFrame:
    """Similarity-weighted mean outcome, bust rate and median of the comparables of every query."""
    sim, y = similarity(bandwidth), F.col(outcome)
    agg = comps.groupBy(spec.ids).agg(
        F.try_divide(F.sum(sim * y), F.sum(sim)).alias("comp_weighted_ppg"),
        F.avg((y < bust_below).cast("double")).alias("comp_bust_rate"),
        F.percentile(y, 0.5).alias("comp_median_ppg"))
    sizes = params.select(spec.block, F.col("cohort").alias(spec.year), F.col("n_pool").alias("n_pool_used"))
    out = attach(queries.select(spec.ids, spec.block, spec.year), sizes, [spec.block, spec.year])
    return out.join(agg, spec.ids, "left").withColumn("n_pool_used", F.coalesce("n_pool_used", F.lit(0)))


def comp_errors(found: DataFrame, actual: str, outcome: str, settings: Sequence[tuple[int, float]]) -> DataFrame:
    """Per variant and (number of neighbours, bandwidth): how many queries have an estimate, the similarity-weighted mean outcome of
    their comparables, and its root mean squared error.

    `found` has one row per query and variant with the array `comps`; a batch of them is laid against all settings as arrays, and
    one sum per variant and setting is sent on.
    """
    most = max(k for k, _ in settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            distances, outcomes, variant = batch.column("distance"), batch.column("outcome"), batch.column("variant").to_numpy()
            actual_, n_variants = batch.column("actual"), int(variant.max()) + 1
            known, truth = actual_.is_valid().to_numpy(zero_copy_only=False), actual_.to_numpy(zero_copy_only=False).astype(float)
            has = np.arange(most) < np.diff(distances.offsets.to_numpy())[:, None]
            flat = outcomes.flatten()
            near, y, with_outcome = np.full(has.shape, np.inf), np.zeros(has.shape), np.zeros(has.shape, bool)
            near[has] = distances.flatten().to_numpy(zero_copy_only=False)
            with_outcome[has] = flat.is_valid().to_numpy(zero_copy_only=False)
            y[with_outcome] = flat.drop_null().to_numpy(zero_copy_only=False)
            some = np.logical_or.accumulate(with_outcome, axis=1)
            out: list[tuple] = []
            for bandwidth in dict.fromkeys(bw for _, bw in settings):
                sim = np.exp(-near / bandwidth)
                total, weighed = sim.cumsum(axis=1), np.where(with_outcome, sim * y, 0.0).cumsum(axis=1)
                for i, (k, bw) in enumerate(settings):
                    if bw == bandwidth:
                        given = some[:, k - 1] & (total[:, k - 1] != 0)
                        measured = given & known
                        miss = weighed[measured, k - 1] / total[measured, k - 1] - truth[measured]
                        sums = (np.bincount(variant[given], minlength=n_variants), np.bincount(variant[measured], minlength=n_variants),
                                np.bincount(variant[measured], np.square(miss), minlength=n_variants))
                        out += [(v, i, *(x[v] for x in sums)) for v in np.flatnonzero(sums[0])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))],
                                             names=["variant", "setting", "n", "m", "squares"])

    rows = found.select("variant", F.col(actual).cast("double").alias("actual"), F.col("comps.distance").alias("distance"),
                        F.col(f"comps.{outcome}").cast("array<double>").alias("outcome"))
    sums = rows.mapInArrow(run, "variant int, setting int, n bigint, m bigint, squares double").groupBy("variant", "setting").agg(
        *[F.sum(c).alias(c) for c in ("n", "m", "squares")])
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(bw)).alias("bandwidth")) for k, bw in settings])
    return sums.withColumn("s", F.get(listed, F.col("setting"))).select(
        "variant", "s.k", "s.bandwidth", "n", F.sqrt(F.try_divide(F.col("squares"), F.col("m"))).alias("rmse"))


def comp_reasons(comps: DataFrame, queries: DataFrame, pool: DataFrame, params: DataFrame, spec: CompSpec,
                 labels: Mapping[str, str], top: int = 3) -> DataFrame:
    """Labels of the features in which a comparable is closest, in units of the feature's scale."""
    feats = F.array(*[F.col(f).cast("double") for f in spec.features])
    left = queries.select(spec.ids, spec.block, F.col(spec.year).alias("cohort"), feats.alias("__q"))
    right = pool.select(F.col(spec.ids).alias("comp_id"), feats.alias("__p"))
    rows = attach(comps.select(spec.ids, "comp_id", "comp_rank").join(left, spec.ids).join(right, "comp_id"),
                  params.select(spec.block, "cohort", "scale"), [spec.block, "cohort"])
    parts = F.array(*[F.struct(
        F.round(F.abs(F.get("__q", F.lit(i)) - F.get("__p", F.lit(i))) / F.get("scale", F.lit(i)), 9).alias("gap"),
        F.lit(i).alias("i"), F.lit(labels.get(f, "")).alias("label")) for i, f in enumerate(spec.features)])
    ranked = F.slice(F.array_sort(F.filter(parts, lambda x: x["gap"].isNotNull())), 1, top)
    named = F.filter(F.transform(ranked, lambda x: x["label"]), lambda t: t != "")
    return rows.select(spec.ids, "comp_id", "comp_rank", F.array_join(named, ", ").alias("reasons"))


def comp_summary(comps: DataFrame, ids: str, outcome: str, name: str,
                 bandwidth: float = presets.COMP_BANDWIDTH, bust_below: float = presets.COMP_BUST_BELOW,
                 hit_at: float = 8.0) -> DataFrame:
    """One row per query: averages, rates and the comparables' names in rank order."""
    sim, y = similarity(bandwidth), F.col(outcome)
    names = F.array_sort(F.collect_list(F.struct("comp_rank", name)))
    return comps.groupBy(ids).agg(
        F.count("*").alias("n_comps"), F.try_divide(F.sum(sim * y), F.sum(sim)).alias("weighted_ppg"),
        F.percentile(y, 0.5).alias("median_ppg"), F.avg((y < bust_below).cast("double")).alias("bust_rate"),
        F.avg((y >= hit_at).cast("double")).alias("hit_rate"),
        F.array_join(F.transform(names, lambda s: s[name]), ", ").alias("names"))
