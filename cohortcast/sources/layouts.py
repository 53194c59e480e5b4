"""Source adaptation: schema drift, optional and preferred sources, eras, layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortcast.operators.grouped import attach


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Project to a declared schema: missing columns become typed nulls, the others are cast."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in target.fields])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_documents(spark: SparkSession, path: str, schema: str, child: str) -> DataFrame:
    """Many JSON documents to one row per element of their `child` array."""
    docs = spark.read.schema(schema).json(path)
    rest = [c for c in docs.columns if c != child]
    return docs.select(*rest, F.explode(child).alias("__c")).select(*rest, "__c.*")


def write_pages(pages: DataFrame, path: str, keys: Sequence[str], html: str) -> None:
    """Cache pages as text files, one per page, in a folder `<key>=<value>/...` each."""
    pages.select(*keys, html).repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def read_pages(spark: SparkSession, path: str, keys: str, shortest: int = 0) -> DataFrame:
    """One row per cached page file: its folder below `path`, its keys and its whole text.

    The folder names the page alike in every run, unlike the file in it. Pages shorter than `shortest` have no text: an
    error page or a broken download.
    """
    files = spark.read.schema(f"value STRING, {keys}").text(path, wholetext=True)
    depth = len(files.columns) - 1
    text = F.when(F.length("value") >= shortest, F.col("value"))
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"((?:[^/]+/){" + str(depth) + r"})[^/]+$", 1).alias("page"),
                        *files.columns[1:], text.alias("html")).withColumn("page", F.rtrim("page", F.lit("/")))


def era_union(older: DataFrame, newer: DataFrame, season: str, cutover: int) -> DataFrame:
    """Older source before the cut-over season, newer source from it on; columns united by name."""
    return older.where(F.col(season) < cutover).unionByName(
        newer.where(F.col(season) >= cutover), allowMissingColumns=True)


def prefer_sources(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All sources stacked, keeping for each key only the rows of its best-ranked source."""
    stacked = None
    for i, src in enumerate(sources):
        tagged = src.withColumn("__priority", F.lit(i))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    best = stacked.groupBy(*keys).agg(F.min("__priority").alias("__best"))
    return attach(stacked, best, keys).where(F.col("__priority") == F.col("__best")).drop(
        "__priority", "__best")


def team_games(df: DataFrame, keys: Sequence[str], count_col: str) -> DataFrame:
    """Games per key from either layout: a row per game, or rows already counted in `count_col`."""
    total = F.sum(count_col) if count_col in df.columns else F.count("*")
    return df.groupBy(*keys).agg(total.cast("bigint").alias(count_col))


def deaggregate(df: DataFrame, count_col: str, index_col: str) -> DataFrame:
    """Repeat every row as often as `count_col` says (no row for 0 or null)."""
    return df.where(F.col(count_col) > 0).withColumn(
        index_col, F.explode(F.sequence(F.lit(1), F.col(count_col).cast("int"))))


def optional_lookup(df: DataFrame, lookup: DataFrame | None, keys: Sequence[str],
                    columns: dict[str, str], flag: str) -> DataFrame:
    """Attach the columns of a lookup that may be absent; `flag` tells whether the row was covered."""
    if lookup is None:
        return df.withColumns({
            **{c: F.lit(None).cast(t) for c, t in columns.items()}, flag: F.lit(0)})
    hit = lookup.select(*keys, *columns, F.lit(1).alias(flag))
    return attach(df, hit, keys, null_safe=False).withColumn(flag, F.coalesce(flag, F.lit(0)))


class DuplicateKeyError(ValueError):
    """A lookup that must hold one row per key holds more."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise unless `keys` identify the rows; the check ends at the first duplicate found."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise DuplicateKeyError(f"several rows for {found[0].asDict()}")
    return df


def clean_numbers(df: DataFrame, digits: int | None = None) -> DataFrame:
    """NaN to null in floating columns, optionally rounded half-even."""
    def fix(name: str, kind: str) -> Column:
        if kind not in ("double", "float"):
            return F.col(name)
        c = F.when(~F.isnan(name), F.col(name))
        return (F.bround(c, digits) if digits is not None else c).alias(name)
    return df.select(*[fix(n, t) for n, t in df.dtypes])
