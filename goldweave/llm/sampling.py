"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def _hashed(ids: DataFrame, salt: int) -> DataFrame:
    return ids.where(F.col("doc_id").isNotNull()).distinct().withColumn("_order", F.xxhash64(F.col("doc_id"), F.lit(salt)))


def lowest(ids: DataFrame, most: int, salt: int = 0) -> DataFrame:
    """Of the distinct rows with a doc_id, at most `most` with the lowest hashes of it: the same choice whatever the partitioning and however often a row repeats. ids has few and narrow columns."""
    return _hashed(ids, salt).orderBy("_order", *ids.columns).limit(most).drop("_order")


def lowest_each(ids: DataFrame, by: str, most: int) -> DataFrame:
    """As lowest(), for each value of a column. Salted first, so that no task gets all rows of a hot value."""
    hashed = _hashed(ids, 0).withColumn("_salt", F.pmod("_order", F.lit(64)))
    for keys in ((by, "_salt"), (by,)):
        order = Window.partitionBy(*keys).orderBy("_order", *ids.columns)
        hashed = hashed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")
    return hashed.drop("_order", "_salt")


def texts_of(docs: DataFrame, chosen: DataFrame, *on: str) -> DataFrame:
    """The chosen rows (few enough to broadcast, as lowest() bounds them) with one text each: of several that agree in the columns `on` the one with the least hash."""
    found = docs.select(*on, "text").join(F.broadcast(chosen), list(on))
    return found.groupBy(*chosen.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
