"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package's modules once an application, as Python functions refer to them by name."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="goldweave-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(_PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(_PACKAGE.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(application)
    return spark


def session(name: str = "goldweave", **options: str) -> SparkSession:
    """A session with adaptive execution and a fixed time zone; options are Spark settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, as spark.checkpoint.dir names it.

    Without that setting a local session, as in tests, gets a temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="goldweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/goldweave-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file system, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; frames that read it are of no use afterwards."""
    remove(spark, shared_folder(spark))
