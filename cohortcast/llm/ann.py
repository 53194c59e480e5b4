"""Nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Unit vectors are projected by a Gaussian matrix onto `DIMS` numbers; a squared projected distance over the squared
true one then follows a chi-square law. A query takes projected neighbours in order of distance, verifies them
on the original vectors and stops once a vector nearer than its k-th best would lie further out with probability
below 1 - `CONFIDENCE`.

A kd-tree over a bounded sample cuts the projected space into regions, so routing never needs more than that sample; a
region with many vectors is split by hash into blocks of about `BLOCK_ROWS`. Each block builds its own
kd-tree in a task and streams the queries past it. Queries first search their own region; the stopping radius
this gives then selects the other regions whose bounding box comes close enough, and only those are searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.session import materialize

DIMS = 16
CONFIDENCE = 0.96
BLOCK_ROWS = 16_384
SAMPLE_ROWS = 20_000      # bound of the sample the regions are cut from
SAMPLE_PER_REGION = 16
LEAF_ROWS = 128
SEED = 17


def chi_square_cdf(x: float, dims: int) -> float:
    """Of an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < p else (low, mid)
    return high


def projection(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dims))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def project(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]) @ projection(vectors.shape[1])


class Regions:
    """A kd-tree over sampled projections; its leaves number the regions. With bounding boxes it routes queries."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.splits: list[tuple[int, float, int, int]] = []
        self.count = 0
        self.root = self._cut(sample, regions)
        self.low = self.high = np.zeros((0, DIMS))
        self.blocks = np.zeros(0, np.int64)

    def _cut(self, sample: np.ndarray, regions: int) -> int:
        """Node number: a split, or -1 - region."""
        if regions > 1 and len(sample) >= 2 * SAMPLE_PER_REGION:
            axis = int(np.argmax(sample.max(0) - sample.min(0)))
            value = float(np.median(sample[:, axis]))
            right = sample[:, axis] > value
            if right.any() and not right.all():
                at = len(self.splits)
                self.splits.append((axis, value, 0, 0))
                a, b = self._cut(sample[~right], regions - regions // 2), self._cut(sample[right], regions // 2)
                self.splits[at] = (axis, value, a, b)
                return at
        self.count += 1
        return -self.count

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        rows = np.arange(len(points))
        while (open_ := node >= 0).any():
            for at in np.unique(node[open_]):
                axis, value, a, b = self.splits[at]
                here = rows[node == at]
                node[here] = np.where(points[here, axis] > value, b, a)
        return -1 - node

    def near(self, point: np.ndarray, radius: float) -> np.ndarray:
        """Regions whose box comes within the squared radius."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero(((gap * gap).sum(1) < radius) & (self.blocks > 0))


class Block:
    """kd-tree over the projections of a block: leaves of neighbouring rows with their bounding boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        points = project(vectors)
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            spread = points[rows].max(0) - points[rows].min(0)
            if len(rows) <= LEAF_ROWS or not spread.any():
                leaves.append(rows)
                continue
            order = rows[np.argsort(points[rows, int(spread.argmax())], kind="stable")]
            todo += [order[:len(rows) // 2], order[len(rows) // 2:]]
        order = np.concatenate(leaves)
        self.ids, self.points, self.vectors = ids[order], points[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, worst: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of up to k rows; `worst` is a cosine that k rows are known to reach."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        bound = (gap * gap).sum(1)
        order = np.argsort(bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        norm, at, step = math.sqrt(float((vector * vector).sum())), 0, 1
        while at < len(order):
            radius = stop_radius(worst, factor)
            leaves = [leaf for leaf in order[at:at + step] if bound[leaf] < radius]
            if not leaves:
                break
            rows = np.concatenate([np.arange(self.at[x], self.at[x + 1]) for x in leaves])
            away = self.points[rows] - point
            rows = rows[(away * away).sum(1) < radius]
            cosine = (self.vectors[rows] * vector).sum(1) / (self.norms[rows] * norm)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, cosine])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                worst = max(worst, float(scores[-1]))
            at, step = at + step, min(step * 2, 32)
        return ids, scores


def stop_radius(worst: float, factor: float) -> float:
    """Squared projected distance at which the stopping test holds for the k-th best cosine `worst`."""
    return math.inf if worst == -math.inf else max(2 - 2 * worst, 1e-12) * factor * (1 + 1e-9)


def _usable(column: str) -> Column:
    value = F.col(column)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(value, lambda x: x != 0)


def _stream(k: int, factor: float):
    """Over rows sorted by block with its vectors before its queries: build each block, then search query by query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            out = []
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                key, query = tuple(keys[:2, start]), keys[2, start]
                part = batch.slice(start, end - start)
                if key != current:
                    current, held, block = key, [], None
                if not query:
                    held.append(part)
                    continue
                if block is None and held:
                    block = Block(np.concatenate([p.column(3).to_numpy() for p in held]), np.concatenate([matrix(p.column(4)) for p in held]))
                    held = []
                if block is None:
                    continue
                vectors = matrix(part.column(4))
                points = project(vectors)
                for i, (name, worst) in enumerate(zip(part.column(3).to_numpy(), part.column(5).to_numpy(zero_copy_only=False))):
                    ids, scores = block.search(vectors[i], points[i], k, float(worst), factor)
                    out.append((np.full(len(ids), name), ids, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["query", "vec_id", "score"])
    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_width(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score, rank) of the k nearest; `base` and `asked` are (vec_id, vector) of one width."""
    factor = chi_square_quantile(CONFIDENCE, DIMS)
    rows = base.count()
    sampled = base.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE_ROWS).select("vector")

    def shadows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(project(matrix(batch.column(0))).tolist(), pa.list_(pa.float64()))], names=["point"])

    sample = matrix(sampled.mapInArrow(shadows, "point array<double>").toArrow()["point"].combine_chunks())
    regions = Regions(sample, max(1, -(-rows // BLOCK_ROWS)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = project(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(regions.of(points).astype(np.int32)), *batch.columns, pa.array(points.tolist(), pa.list_(pa.float64()))],
                    names=["region", "vec_id", "vector", "point"])

    kind = base.schema["vector"].dataType.simpleString()
    shape = f"region int, vec_id bigint, vector {kind}, point array<double>"
    stored = materialize(base.mapInArrow(placed, shape), "ann-base")
    boxes = stored.groupBy("region").agg(
        F.count("*").alias("n"), *[F.min(F.col("point")[d]).alias(f"l{d}") for d in range(DIMS)], *[F.max(F.col("point")[d]).alias(f"h{d}") for d in range(DIMS)]).collect()
    regions.low, regions.high = np.zeros((regions.count, DIMS)), np.zeros((regions.count, DIMS))
    regions.blocks = np.zeros(regions.count, np.int64)
    for box in boxes:  # at most as many as the bounded sample can cut
        regions.low[box["region"]] = [box[f"l{d}"] for d in range(DIMS)]
        regions.high[box["region"]] = [box[f"h{d}"] for d in range(DIMS)]
        regions.blocks[box["region"]] = -(-box["n"] // BLOCK_ROWS)
    blocks = F.array(*[F.lit(int(b)) for b in regions.blocks])
    side = stored.select("region", F.pmod(F.xxhash64("vec_id"), blocks[F.col("region")]).cast("int").alias("block"), F.lit(0).alias("is_query"),
                         "vec_id", "vector", F.lit(None).cast("double").alias("worst"))

    def searched(visits: DataFrame) -> DataFrame:
        spread = visits.select("region", F.explode(F.sequence(F.lit(0), blocks[F.col("region")] - 1)).alias("block"), F.lit(1).alias("is_query"),
                               "vec_id", "vector", "worst")
        both = side.union(spread).repartition("region", "block").sortWithinPartitions("region", "block", "is_query")
        return both.mapInArrow(_stream(k, factor), "query bigint, vec_id bigint, score double")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = project(matrix(batch.column(1)))
                gap = [np.flatnonzero(regions.blocks > 0)[0] if not regions.blocks[r] else r for r in regions.of(points)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(gap, np.int32)), *batch.columns, pa.array([-math.inf] * batch.num_rows)],
                                                 names=["region", "vec_id", "vector", "worst"])

    visit = f"region int, vec_id bigint, vector {kind}, worst double"
    home = materialize(asked.mapInArrow(homes, visit), "ann-queries")
    found = materialize(_first(searched(home), k), "ann-home")
    reached = found.groupBy(F.col("query").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = home.join(reached, "vec_id", "left").select(
        "region", "vec_id", "vector", F.when(F.col("n") >= k, F.col("low")).otherwise(float("-inf")).alias("worst"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = project(matrix(batch.column(2)))
            own, worst = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            near = [regions.near(points[i], stop_radius(float(worst[i]), factor)) for i in range(batch.num_rows)]
            near = [n[n != own[i]] for i, n in enumerate(near)]
            rows = np.repeat(np.arange(batch.num_rows), [len(n) for n in near])
            again = batch.take(pa.array(rows))
            region = np.concatenate(near).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(region), *again.columns[1:]], names=["region", "vec_id", "vector", "worst"])

    beyond = searched(known.mapInArrow(others, visit))
    return _first(found.select("query", "vec_id", "score").union(beyond), k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine of every row whose id is divisible by `every`.

    Output: query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller vec_id. A query's own row is no
    candidate. Rows with a null id, or whose vector is null, empty, zero or holds null or non-finite numbers, take no
    part; vectors of different widths are not compared; of rows that repeat an id the one with the smallest vector
    counts; other columns are ignored; with fewer than k candidates all are returned; an empty table gives an empty result.

    Rows with equal vectors tie, so of such a group only the k + 1 smallest ids can be among anyone's k nearest: the others are left out of the
    index before any task sees them, and equal query vectors are searched once, for k + 1 rows.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vector"))
    rows = materialize(rows.where(F.col("vec_id").isNotNull() & _usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector")), "ann-rows")
    alike = Window.partitionBy("vector").orderBy("vec_id")
    base = materialize(rows.withColumn("at", F.row_number().over(alike)).where(F.col("at") <= k + 1).drop("at"), "ann-distinct")
    queries = rows.where(F.col("vec_id") % every == 0)
    named = queries.groupBy("vector").agg(F.min("vec_id").alias("query"))
    widths = [r["w"] for r in base.select(F.size("vector").alias("w")).distinct().collect()]
    found = None
    for width in widths:
        asked = named.where(F.size("vector") == width).select(F.col("query").alias("vec_id"), "vector")
        part = _search_width(base.where(F.size("vector") == width), asked, k + 1)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every_query = queries.join(named, "vector").select("query", F.col("vec_id").alias("query_id"))
    mine = found.select("query", "vec_id", "score").join(every_query, "query").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
