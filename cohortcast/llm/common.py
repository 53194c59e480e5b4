"""What the text operators share: word rules, row keys and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
TEXTS_PER_BATCH = 256


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of `WORD` matches."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def null_safe(column: Column) -> Column:
    """A never-null join key that keeps null apart from every value."""
    return F.struct(column.isNull().alias("none"), column.alias("some"))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def map_texts(df: DataFrame, columns: list[str], schema: str | StructType, rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply `rows` to small Arrow slices of `columns`, so memory does not depend on the batch size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_BATCH):
                yield rows(batch.slice(at, TEXTS_PER_BATCH))
    return df.select(*columns).mapInArrow(run, schema)


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """The rows of `df` as one struct `__row` beside columns made from them, so no column's name can clash; `select("__row.*")` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *more)
