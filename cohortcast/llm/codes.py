"""Product codes of vectors by exact rounds of nearest-entry search under norm-of-sum bounds.

A vector is cut into parts, every part position has a codebook of whole numbers, and each round assigns all parts to
their nearest entries and moves the entries to the floor of their parts' mean. A part keeps one number between
rounds: the distance to its second nearest entry when that was last measured, stamped with the round. All codebooks since
the first are kept, so in a later round that number less the largest true displacement of the other entries since the
stamp (the norm of the sum of their moves, never more than the sum of the norms) is a lower bound. Only parts whose
own entry is not nearer than that are measured against the whole codebook again.

A round is one pass over a written table. Its sums are added up in the tasks, then by `groupBy`; the driver sees
the codebooks, whose size is that of `entries` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.session import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 20          # whole numbers beyond +-LARGEST count as it, so that all sums are exact in a double
BATCH_ROWS = 4096
HAIR = 1e-6                # room for rounding between a bound and a distance


def finite_vector(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    value = F.col(column)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` components as whole numbers in float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).reshape(len(column), width)


def cuts(width: int, parts: int) -> list[slice]:
    return [slice(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries; whole numbers below 2^53, so exact."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


def _measure(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index on ties), its squared distance, and the distance to the nearest of the others."""
    d = _squares(x, entries)
    rows = np.arange(len(x))
    code = d.argmin(1)
    own = d[rows, code].copy()
    d[rows, code] = np.inf
    return code, own, np.sqrt(d.min(1)) if len(entries) > 1 else np.full(len(x), np.inf)


def _drift(now: np.ndarray, then: np.ndarray) -> np.ndarray:
    """For each entry the largest net displacement among the other ones."""
    moved = np.sqrt(((now - then) ** 2).sum(1))
    if len(moved) < 2:
        return np.zeros(len(moved))
    first, second = np.argsort(-moved, kind="stable")[:2]
    out = np.full(len(moved), moved[first])
    out[first] = moved[second]
    return out


def assign_part(x: np.ndarray, history: Sequence[np.ndarray], state: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Codes, squared distances, bounds and stamps against the last codebook of `history`; and which rows were measured in full.

    `state` holds code, bound and stamp from an earlier round, None in the first.
    """
    now = len(history) - 1
    if state is None:
        code, own, bound = _measure(x, history[now])
        return code, own, bound, np.full(len(x), now), np.ones(len(x), bool)
    code, bound, stamp = (a.copy() for a in state)
    away = x - history[now][code]
    own = (away * away).sum(1)
    drift = np.stack([_drift(history[now], then) for then in history])
    again = ~(np.sqrt(own) + HAIR < bound - drift[stamp, code])
    if again.any():
        code[again], own[again], bound[again] = _measure(x[again], history[now])
        stamp[again] = now
    return code, own, bound, stamp, again


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as binary values."""
    values = np.ascontiguousarray(values)
    size = values.itemsize * values.shape[1]
    offsets = (np.arange(len(values) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _read(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), parts)


def _assigner(history: list[np.ndarray], parts: int):
    """One round over (vec_id, label, vector, code, bound, stamp, rescans); `history` are codebooks of shape (entries, width)."""
    width = history[0].shape[1]
    at = cuts(width, parts)
    first = len(history) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, BATCH_ROWS):
                batch = big.slice(start, BATCH_ROWS)
                n = batch.num_rows
                x = whole(batch.column(2), width)
                code, bound, stamp = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts), np.uint8)
                error, rescans = np.zeros(n), np.zeros(n, np.int64)
                if not first:
                    code, bound, stamp = (_read(batch.column(c), kind, parts).copy() for c, kind in ((3, np.uint8), (4, np.float64), (5, np.uint8)))
                    rescans = batch.column(6).to_numpy().copy()
                for p, cut in enumerate(at):
                    books = [h[:, cut] for h in history]
                    held = None if first else (code[:, p], bound[:, p], stamp[:, p])
                    code[:, p], own, bound[:, p], stamp[:, p], again = assign_part(x[:, cut], books, held)
                    error += own
                    rescans += 0 if first else again
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), _fixed(code), _fixed(bound), _fixed(stamp), pa.array(rescans), pa.array(error.astype(np.int64))],
                    names=["vec_id", "label", "vector", "code", "bound", "stamp", "rescans", "error"])
    return run


def _summer(width: int, entries: int, parts: int):
    """Per task one row for each used (component, entry): how many parts, and their sum."""
    at = cuts(width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((width, entries)), np.zeros((width, entries))
        for big in batches:
            for start in range(0, big.num_rows, BATCH_ROWS):
                batch = big.slice(start, BATCH_ROWS)
                x, code = whole(batch.column(0), width), _read(batch.column(1), np.uint8, parts)
                for p, cut in enumerate(at):
                    counts = np.bincount(code[:, p], minlength=entries)
                    for c in range(cut.start, cut.stop):
                        total[c] += np.bincount(code[:, p], weights=x[:, c], minlength=entries)
                        used[c] += counts
        component, entry = np.nonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(component.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(used[component, entry].astype(np.int64)),
                                          pa.array(total[component, entry].astype(np.int64))], names=["component", "entry", "n", "total"])
    return run


def digest(book: np.ndarray, parts: int) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    numbers = [str(int(v)) for cut in cuts(book.shape[1], parts) for row in book[:, cut] for v in row]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _compress_width(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Codes of the vectors of one width, and the final codebooks."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # `entries` rows
    history = [np.clip(np.floor(np.array([r["vector"] for r in seeds], np.float64).reshape(len(seeds), width) * SCALE), -LARGEST, LARGEST)]
    kinds = dict(rows.dtypes)
    schema = (f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector {kinds['vector']}, "
              "code binary, bound binary, stamp binary, rescans bigint, error bigint")
    state = materialize(rows.mapInArrow(_assigner(history, parts), schema), "codes-round")
    for _ in range(rounds):
        sums = state.select("vector", "code").mapInArrow(_summer(width, len(seeds), parts), "component int, entry int, n bigint, total bigint")
        cells = sums.groupBy("component", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # width * entries rows at most
        book = history[-1].copy()
        for cell in cells:
            book[cell["entry"], cell["component"]] = cell["total"] // cell["n"]
        history.append(book)
        state = materialize(state.drop("error").mapInArrow(_assigner(history, parts), schema), "codes-round")
    return state, history[-1]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id",
             vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Product codes: vec_id, code, error, label_error, codebooks_sha256, rescans.

    `code` lists the entry of every part in two hex digits, `error` is the squared distance to the coded vector,
    `label_error` its sum over the rows of the label, `rescans` how many parts were measured in full after the first round.
    Components are the floor of 256 times their value; those beyond 2^20 in size count as 2^20. Entries start as the vectors of the smallest ids.

    Rows whose vector is null or holds null or non-finite numbers are left out. Rows with a null label are a label of
    their own; null ids come after all others where entries are chosen; repeated ids and rows are rows of their own, of
    equal ids the smaller vector seeds first; fewer rows than entries give as many entries. Vectors of different widths
    have codebooks of their own; a width that `parts` does not divide is cut as evenly as whole numbers allow; an empty vector
    has code 0 throughout and error 0. A sum of errors beyond 64 bits is null. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < entries <= 256 or rounds > 254:
        raise ValueError("codes and stamps are kept in bytes")
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    rows = materialize(rows.where(finite_vector("vector")), "codes-rows")
    coded = None
    for width in sorted(r["w"] for r in rows.select(F.size("vector").alias("w")).distinct().collect()):
        state, book = _compress_width(rows.where(F.size("vector") == width), width, parts, entries, rounds)
        part = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", F.lit(digest(book, parts)).alias("codebooks_sha256"), "rescans")
        coded = part if coded is None else coded.unionByName(part)
    if coded is None:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit("").alias("codebooks_sha256"),
                            F.lit(0).cast("bigint").alias("rescans")).where(F.lit(False))
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.expr("try_sum(error)").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256", "rescans")
