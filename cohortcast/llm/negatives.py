"""Hard negatives of anchors by slot-decomposed selection.

Every anchor has a few positives, and every positive asks for the highest-scoring rows of other labels inside a window of
scores that follows its own score. The upper limits of an anchor's windows cut its scores into disjoint slots: slot i
holds the scores up to limit i and above limit i + 1. Each task keeps the `k` best rows per anchor and slot,
which are merged by rank, and merging the slots from the lowest limit upwards answers every window: its rows are the `k`
best of its own slot and those below, as far as its lower limit.

Anchors meet all rows in blocks of bounded size on both sides; a task holds one block of anchors and streams rows past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.llm.codes import finite_vector, whole
from cohortcast.session import materialize

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH, OF = 30, 90, 100     # a negative scores LOW to HIGH hundredths of the positive
ANCHORS_EVERY = 100
ANCHOR_BLOCK = 32_768
ROW_BLOCK = 16_384
ANCHORS_AT_ONCE = 1024
ROWS_AT_ONCE = 1024
NO_ID = np.iinfo(np.int64).max


class Best:
    """The `k` highest scores per place, ties to the smaller id, under candidates that come with ascending ids."""

    def __init__(self, places: int, k: int):
        self.k = k
        self.scores = np.full((places, k), -np.inf)
        self.ids = np.full((places, k), NO_ID)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        places, k = np.unique(at), self.k
        at = np.concatenate([np.repeat(places, k), at])
        ids = np.concatenate([self.ids[places].ravel(), ids])
        scores = np.concatenate([self.scores[places].ravel(), scores])
        order = np.lexsort((ids, -scores, at))
        at = at[order]
        first = np.searchsorted(at, places)
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        self.scores[places], self.ids[places] = scores[kept].reshape(-1, k), ids[kept].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, _ = np.nonzero(self.ids != NO_ID)
        held = self.ids != NO_ID
        return place, self.ids[held], self.scores[held]


class PositiveSearch:
    """Best rows of an anchor's own label, itself left out."""

    slots = 1

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, limits: np.ndarray, k: int):
        self.ids, self.labels, self.vectors, self.best = ids, labels, vectors, Best(len(ids), k)

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            mine = np.flatnonzero(self.labels == label)
            for start in range(0, len(mine), ANCHORS_AT_ONCE):
                some = mine[start:start + ANCHORS_AT_ONCE]
                scores = self.vectors[some] @ vectors[rows].T
                good = scores > self.best.scores[some, -1][:, None]
                good &= self.ids[some][:, None] != ids[rows][None, :]
                a, r = np.nonzero(good)
                if len(a):
                    self.best.add(some[a], ids[rows[r]], scores[a, r])


class SlotSearch:
    """Best rows of other labels in every slot; `limits` are the upper limits, descending, then the lower ones."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, limits: np.ndarray, k: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.slots = limits.shape[1] // 2
        self.high, low = limits[:, :self.slots], limits[:, self.slots:]
        # no window that a slot serves goes below the lower limit of the slot's own positive
        self.floor = np.where(np.isnan(low), np.inf, low - 1)
        self.best = Best(len(ids) * self.slots, k)

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(self.ids), ANCHORS_AT_ONCE):
            some = slice(start, start + ANCHORS_AT_ONCE)
            scores = self.vectors[some] @ vectors.T
            slot = np.full(scores.shape, -1, np.int8)
            for i in range(self.slots):
                slot += scores <= self.high[some, i][:, None]
            worst = self.best.scores[:, -1].reshape(-1, self.slots)[some]
            # scores above every limit are in no slot: index -1 finds the last column
            bar = np.concatenate([np.maximum(worst, self.floor[some]), np.full((len(worst), 1), np.inf)], 1)
            good = scores > np.take_along_axis(bar, slot.astype(np.intp), 1)
            good &= self.labels[some][:, None] != labels[None, :]
            a, r = np.nonzero(good)
            if len(a):
                self.best.add((start + a) * self.slots + slot[a, r], ids[r], scores[a, r])


def _stream(search: type, k: int, slots: int):
    """Over rows sorted by block, anchors before rows and rows by id: hold the anchors of a block, stream the rows past them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, now, seen = None, [], None, 0

        def result() -> Iterator[pa.RecordBatch]:
            if now is not None:
                place, ids, scores = now.best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(now.ids[place // now.slots]), pa.array((place % now.slots).astype(np.int32)), pa.array(ids),
                                                  pa.array(scores.astype(np.int64))], names=["anchor_id", "slot", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                width, is_row = int(keys[0, start]), keys[3, start]
                if key != tuple(keys[:3, start]):
                    yield from result()
                    key, held, now, seen = tuple(keys[:3, start]), [], None, 0
                part = batch.slice(start, end - start)
                ids, labels, vectors = part.column(4).to_numpy(), part.column(5).to_numpy(), whole(part.column(6), width)
                if not is_row:
                    limits = np.array([list(x or ()) + [None] * (2 * slots - len(x or ())) for x in part.column(7).to_pylist()], np.float64).reshape(len(part), 2 * slots)
                    held.append((ids, labels, vectors, limits))
                    continue
                if now is None and held:
                    now, held = search(*[np.concatenate(c) for c in zip(*held)], k), []
                if now is None:
                    continue
                at = 0
                while at < len(ids):  # few rows at first, while every row is a candidate
                    step = slice(at, at + min(ROWS_AT_ONCE, max(32, seen)))
                    now.see(ids[step], labels[step], vectors[step])
                    at, seen = step.stop, seen + step.stop - step.start
        yield from result()
    return run


def _searched(rows: DataFrame, anchors: DataFrame, search: type, k: int, slots: int, row_block: int, anchor_block: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the `k` best per anchor and slot, over all rows."""
    row_blocks, anchor_blocks = (max(1, -(-side.count() // size)) for side, size in ((rows, row_block), (anchors, anchor_block)))
    def cell(own: str, blocks: int, other: str, others: int, side: int, limits: Column) -> list[Column]:  # noqa: E306
        number = {own: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))}
        return [F.size("vector").alias("width"), number["a"].alias("a"), number["r"].alias("r"), F.lit(side).alias("side"), F.col("vec_id"), F.col("label"), F.col("vector"), limits]
    none = F.lit(None).cast("array<double>").alias("limits")
    left = anchors.select(*cell("a", anchor_blocks, "r", row_blocks, 0, F.col("limits") if "limits" in anchors.columns else none))
    right = rows.select(*cell("r", row_blocks, "a", anchor_blocks, 1, none))
    both = left.union(right).repartition("width", "a", "r").sortWithinPartitions("width", "a", "r", "side", "vec_id")
    found = both.mapInArrow(_stream(search, k, slots), "anchor_id bigint, slot int, vec_id bigint, score bigint")
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)


def _suffixes(items: Column, positives: int, k: int) -> Column:
    """For each slot the `k` best of its items and all lower slots', by merging from the last slot up; items are (slot, worse, vec_id)."""
    kind = "array<array<struct<worse:bigint,vec_id:bigint>>>"

    def merge(done: Column, slot: Column) -> Column:
        own = F.transform(F.filter(items, lambda x: x["slot"] == slot), lambda x: F.struct(x["worse"].alias("worse"), x["vec_id"].alias("vec_id")))
        below = F.coalesce(F.get(done, F.lit(0)), F.array().cast("array<struct<worse:bigint,vec_id:bigint>>"))
        return F.concat(F.array(F.slice(F.array_sort(F.concat(own, below)), 1, k)), done)
    return F.aggregate(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), F.array().cast(kind), merge)


def _whole_part(x: Column) -> Column:
    """floor(x / OF) of a whole number."""
    return (x - F.pmod(x, F.lit(OF))) / OF


def mine(vectors: DataFrame, every: int = ANCHORS_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, id_column: str = "vec_id",
         vector_column: str = "embedding", label_column: str = "label", row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; their positives the `positives` highest-scoring other rows of the
    same label; a positive's negatives the `negatives` highest-scoring rows of other labels that score 30 to 90 hundredths
    of it. Scores are inner products of the components' floors of 256 times their value (beyond 2^20 in size they count as 2^20); ties go to the smaller id.

    Rows with a null id, label or vector, or with null or non-finite components, take no part; of rows that repeat an id the one
    with the smallest vector, then label, counts; vectors of different widths are not compared; a positive that scores below 0
    has an empty window; pairs without a negative give no row. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"), F.col(vector_column).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_vector("vector"))
    rows = materialize(rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("one")).select("vec_id", "one.label", "one.vector"), "negatives-rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    found = _searched(rows, anchors, PositiveSearch, positives, 1, row_block, anchor_block)
    pairs = materialize(found.select("anchor_id", (F.col("at") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    high, low = (x.cast("double") for x in (_whole_part(F.col("positive_score") * HIGH), -_whole_part(F.col("positive_score") * -LOW)))
    none = F.lit(None).cast("double")
    of = [F.max(F.when(F.col("slot") == i, limit)) for limit in (high, low) for i in range(positives)]
    limits = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array(*[F.coalesce(x, none) for x in of]).alias("limits"))
    best = _searched(rows, anchors.join(limits, "vec_id"), SlotSearch, negatives, positives, row_block, anchor_block)

    items = F.collect_list(F.struct("slot", (-F.col("score")).alias("worse"), "vec_id"))
    windows = best.groupBy("anchor_id").agg(items.alias("items"))  # positives * negatives items at most
    windows = windows.select("anchor_id", F.posexplode(_suffixes(F.col("items"), positives, negatives)).alias("slot", "best"))
    in_window = pairs.join(windows, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "positive_score",
        F.posexplode(F.filter("best", lambda x: -x["worse"] * OF >= F.col("positive_score") * LOW)).alias("rank", "one"))
    return in_window.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("one.vec_id").alias("negative_id"), "positive_score",
                            (-F.col("one.worse")).alias("negative_score"))
