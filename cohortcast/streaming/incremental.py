"""Read-through cache of partitions: compute and add only what the target does not hold yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def present_partitions(spark: SparkSession, path: str, column: str, kind: str) -> DataFrame:
    """Partition values already stored: the names of the target's folders, none where it does not exist.

    Any other fault of reading (rights, a broken file system) is raised.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()] if files.exists(folder) else []
    values = [n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")]
    return spark.createDataFrame([(v,) for v in values], f"{column} string").select(
        F.when(F.col(column) != "__HIVE_DEFAULT_PARTITION__", F.col(column)).cast(kind).alias(column))


def fill_missing(source: DataFrame, path: str, column: str,
                 compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute the partitions of `source` absent from `path`, add them, return the whole target."""
    spark = source.sparkSession
    kind = dict(source.dtypes)[column]
    have = present_partitions(spark, path, column, kind)
    todo = source.join(have, column, "left_anti")
    result = compute(todo)
    if kind not in ("int", "bigint", "string"):
        raise TypeError(f"partition column of type {kind}")
    (result.hint("rebalance", column).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))
    return spark.read.parquet(path).withColumn(column, F.col(column).cast(kind)).select(result.columns)
