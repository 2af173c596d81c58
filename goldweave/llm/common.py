"""What the operators of this subpackage share: reading, cutting lineage, and batch sizes."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import cut as stage
from ..sources.session import remove, shared_folder, ship

__all__ = ["fit_once", "kinds", "prepare", "remove", "shared_folder", "stage", "table"]

#: Rows and bytes of one Arrow batch, so that a worker never holds more than a few tens of MB of texts.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches; an engine that lacks the byte limit keeps the row limit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; Spark's reader is the only one that is used."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def kinds(df: DataFrame, *columns: str) -> str:
    """The schema of some columns as text."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def fit_once(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What fit makes of rows, which the caller has bounded. It runs in one task, so that the driver holds the model alone; fit must not depend on the rows' order."""

    def run(found: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([pickle.dumps(fit(found))], pa.binary())})

    got = rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(rows.limit(0).toArrow())
