"""Row hashes and validity histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUSTOMER = ("first_name", "last_name", "email", "phone", "dq_score")
ADDRESS = ("address_type", "street", "city", "postal_code", "country", "is_primary", "dq_score")
#: The end of what is still valid.
OPEN = "9999-12-31"


def row_hash(columns: tuple[str, ...]) -> Column:
    """SHA-256 of the columns as text, nulls as nothing, parted by bars."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def history(versions: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Validity periods of each key: a version opens one where its hash differs from the version before; the next closes it.

    The time of a version is its row_timestamp; versions without one come first.
    """
    order = Window.partitionBy(key).orderBy("file_date")
    changed = versions.withColumn("row_hash", row_hash(columns)).withColumn("_before", F.lag("row_hash").over(order)).where(F.col("_before").isNull() | (F.col("row_hash") != F.col("_before")))
    until = F.coalesce(F.lead("row_timestamp").over(order), F.lit(OPEN).cast("timestamp"))
    out = changed.withColumn("valid_from", F.col("row_timestamp")).withColumn("valid_to", until).withColumn("is_valid", F.col("valid_to") == F.lit(OPEN).cast("timestamp"))
    return out.drop("_before", "row_timestamp", "file_date")


def current(versions: DataFrame, key: str) -> DataFrame:
    """The version of each key with the latest file date; one without a date only where there is no other."""
    rest = [c for c in versions.columns if c != key]
    at = F.struct(F.coalesce("file_date", F.lit("0001-01-01").cast("date")), F.coalesce("row_timestamp", F.lit("0001-01-01").cast("timestamp")))
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("row")).select(key, *[F.col(f"row.{c}") for c in rest])


def at_time(periods: DataFrame, moment: str, closed: bool = True) -> DataFrame:
    """Rows valid at a time. A closed interval also gives the version that ends just then; a half-open one doesn't."""
    t = F.lit(moment).cast("timestamp")
    return periods.where((F.col("valid_from") <= t) & ((F.col("valid_to") >= t) if closed else (F.col("valid_to") > t)))


def apply_snapshot(kept: DataFrame, golden: DataFrame, columns: tuple[str, ...], at: Column) -> DataFrame:
    """A stored history (customer_id, columns, row_hash, valid_from, valid_to, is_current) after new golden rows (customer_id, columns).

    Unchanged rows stay; of a changed row the open version is closed at the given time and a new one opened; others are opened.
    """
    new = golden.withColumn("row_hash", row_hash(columns)).select("customer_id", *columns, "row_hash")
    open_ = kept.where("is_current").select("customer_id", F.col("row_hash").alias("_old"))
    changed = new.join(open_, "customer_id", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("row_hash"))).drop("_old")
    closing = changed.select("customer_id", F.lit(True).alias("_closed"))
    closed = kept.join(closing, "customer_id", "left").withColumn("_now", F.col("is_current") & F.coalesce("_closed", F.lit(False)))
    closed = closed.withColumn("valid_to", F.when(F.col("_now"), at).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~F.col("_now"))
    opened = changed.withColumn("valid_from", at).withColumn("valid_to", F.lit(OPEN).cast("timestamp")).withColumn("is_current", F.lit(True))
    return closed.select(*opened.columns).unionByName(opened)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change events between golden rows (customer_id, row_hash, valid_from): INSERT, UPDATE, NO_CHANGE, and CLOSE for what is gone."""
    old = before.select("customer_id", F.col("row_hash").alias("previous_hash"), F.col("valid_from").alias("previous_valid_from"))
    new = after.select("customer_id", "row_hash", "valid_from")
    kind = F.when(F.col("row_hash").isNull(), "CLOSE").when(F.col("previous_hash").isNull(), "INSERT").when(F.col("row_hash") == F.col("previous_hash"), "NO_CHANGE").otherwise("UPDATE")
    return new.join(old, "customer_id", "full_outer").withColumn("event_type", kind)


def reassignments(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cross-reference events between memberships (source_system, source_key, cluster_id): ASSIGN for new records, REASSIGN for moved ones."""
    keys = ["source_system", "source_key"]
    pairs = after.join(before.select(*keys, F.col("cluster_id").alias("previous_cluster_id")), keys, "left")
    kind = F.when(F.col("previous_cluster_id").isNull(), "ASSIGN").when(F.col("previous_cluster_id") != F.col("cluster_id"), "REASSIGN")
    return pairs.withColumn("event_type", kind).where("event_type is not null")
