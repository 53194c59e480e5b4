"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cohortcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, else the warehouse folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path; once per application.

    The archive lies in the shared folder and is fetched from there by Spark.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cohortcast_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("cohortcast", os.path.relpath(path, root)))
    uri = f"{shared_dir(spark)}/{sc.applicationId}/cohortcast.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(uri)
    sc._cohortcast_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's own folder, which can be removed once it has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later readers see identical rows even after an executor is lost, the plan above starts from a
    scan, and Spark knows the true size when it chooses between broadcast and shuffle joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
