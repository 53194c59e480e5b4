"""Documents for readers: per group, per entity with children, dossiers, index data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.operators.grouped import attach

EXPLICIT_NULLS = {"ignoreNullFields": "false"}


def lines_per_group(df: DataFrame, group: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One JSON line per row, ready to be written into a folder per group.

    The lines of a group are in `order` within each file and from file to file, whatever the group's size.
    """
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    return placed.select(group, F.to_json(F.struct(*fields), EXPLICIT_NULLS).alias("document"))


def documents_with_children(parents: DataFrame, children: DataFrame, ids: str, rank: str,
                            child_fields: Sequence[str]) -> DataFrame:
    """One JSON document per parent with its ranked children (bounded by their rank), maybe none."""
    nested = children.groupBy(ids).agg(F.array_sort(F.collect_list(F.struct(rank, *child_fields))).alias("children"))
    out = parents.select(ids).join(nested, ids, "left").withColumn(
        "children", F.coalesce("children", F.array().cast(dict(nested.dtypes)["children"])))
    return out.select(ids, F.to_json(F.struct(ids, "children"), EXPLICIT_NULLS).alias("document"))


def feature_block(features: Mapping[str, tuple[Column, Column, str]]) -> Column:
    """Array of (feature, value, percentile, description) from name -> (value, percentile, text)."""
    return F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value"), p.cast("int").alias("percentile"),
                              F.lit(t).alias("description")) for n, (v, p, t) in features.items()])


def key_values(columns: Sequence[str], skip: Sequence[str] = ()) -> Column:
    """Raw dump of a row as (field, value) strings."""
    return F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                     for c in columns if c not in skip])


def dossiers(df: DataFrame, history: DataFrame, ids: str, season: str, history_fields: Sequence[str],
             summary: Sequence[str], block: Column, raw: Column) -> DataFrame:
    """One document per entity: summary, described features, season by season history, raw fields."""
    path = history.groupBy(ids).agg(F.array_sort(F.collect_list(F.struct(season, *history_fields))).alias("trajectory"))
    out = attach(df.select(ids, *[c for c in summary if c != ids], block.alias("features"), raw.alias("raw")), path, [ids])
    return out.select(ids, F.to_json(F.struct(
        F.struct(*summary).alias("summary"), "features", "trajectory", "raw"), EXPLICIT_NULLS).alias("document"))


def write_documents(docs: DataFrame, path: str, partition: str | None = None) -> None:
    """Documents as text lines, in folders per partition value where one is given."""
    if partition:
        docs.select(partition, "document").write.mode("overwrite").partitionBy(partition).text(path)
    else:
        docs.select("document").write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")


def index_document(df: DataFrame, year: str, position: str) -> DataFrame:
    """Available years and positions and the number of rows, as one row."""
    kinds = df.groupBy(year, position).agg(F.count("*").alias("n"))
    return kinds.agg(F.sort_array(F.collect_set(year)).alias("years"), F.sort_array(F.collect_set(position)).alias("positions"),
                     F.sum("n").alias("total"))
