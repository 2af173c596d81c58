"""The best value of each attribute of a cluster: valid values first, then trusted sources, then recent rows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MdmConfig
from ..functions import text as T


def priority(config: MdmConfig, system: str = "source_system") -> Column:
    out = F.lit(config.other_priority)
    for name, rank in config.priorities:
        out = F.when(F.col(system) == name, rank).otherwise(out)
    return out


def valid_name(c: str) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 1, F.lit(False))


def valid_email(c: str) -> Column:
    return F.coalesce(F.instr(F.col(c), "@") > 0, F.lit(False))


def valid_phone(c: str, config: MdmConfig) -> Column:
    return F.coalesce(F.length(c if config.mode == "bulk" else T.digits(F.col(c))) >= 7, F.lit(False))


def _recent(column: str) -> Column:
    return -F.coalesce(F.unix_seconds(column) if column == "row_timestamp" else F.col(column).cast("long"), F.lit(-(1 << 60)))


def golden_bulk(groups: DataFrame, enriched: DataFrame, config: MdmConfig) -> DataFrame:
    """A golden record for each customer and file date: one aggregation, no window for each attribute. Where no value is valid, the first by trust stays, null or not."""
    rows = groups.join(enriched, ["source_system", "source_key"]).withColumn("p", priority(config)).withColumn("t", _recent("row_timestamp"))
    best = lambda c, valid: F.min_by(c, F.struct((~valid).cast("int").alias("invalid"), "p", "t", "source_key", F.coalesce(c, F.lit("")).alias("value"))).alias(c)
    golden = rows.groupBy("customer_id", "file_date").agg(
        best("first_name", valid_name("first_name")),
        best("last_name", valid_name("last_name")),
        best("email", valid_email("email")),
        best("phone", valid_phone("phone", config)),
        F.max("row_timestamp").alias("row_timestamp"),
    )
    whole = source_count(groups).join(rows.groupBy("customer_id").agg(F.max("is_fake_name").alias("is_fake_name")), "customer_id")
    return golden.join(whole, "customer_id")


def source_count(groups: DataFrame) -> DataFrame:
    return groups.groupBy("customer_id").agg(F.countDistinct("source_system").cast("int").alias("source_count"))


def golden_latest(groups: DataFrame, records: DataFrame, config: MdmConfig) -> DataFrame:
    """A golden record for each customer from the latest rows (with ts). Where no value is valid, the most recent that isn't empty is taken, whatever its source."""
    rows = groups.join(records, ["source_system", "source_key"]).withColumn("p", priority(config)).withColumn("t", -F.col("ts"))

    def best(c: str, valid: Column) -> Column:
        kind = F.when(valid, 0).when(F.col(c) != "", 1).otherwise(2)
        order = F.struct(kind.alias("kind"), F.when(valid, F.col("p")).otherwise(0).alias("p"), "t", "source_system", "source_key")
        return F.min_by(F.nullif(c, F.lit("")), order).alias(c)

    return rows.groupBy("customer_id").agg(
        best("first_name", valid_name("first_name")),
        best("last_name", valid_name("last_name")),
        best("email", valid_email("email")),
        best("phone", valid_phone("phone", config)),
        F.countDistinct("source_system").cast("int").alias("source_count"),
        F.max("ts").alias("ts"),
        F.lit(False).alias("is_fake_name"),
    )


def address_groups(addresses: DataFrame, groups: DataFrame) -> DataFrame:
    """Source addresses with the customer that they belong to; a customer's addresses have its id."""
    owners = groups.select("customer_id", "source_system", F.col("source_key").alias("source_customer_key"))
    linked = addresses.select("source_system", "source_key", "source_customer_key").distinct().join(owners, ["source_system", "source_customer_key"])
    return linked.select(F.col("customer_id").alias("address_id"), "customer_id", "source_system", "source_key", F.col("customer_id").cast("string").alias("cluster_id"))


def golden_addresses(address_groups_: DataFrame, addresses: DataFrame, config: MdmConfig) -> DataFrame:
    """A golden address for each customer and file date."""
    rows = address_groups_.join(addresses, ["source_system", "source_key"]).withColumn("p", priority(config)).withColumn("t", _recent("row_timestamp"))
    tail = ("p", "t", "source_key")
    best = lambda c, valid: F.min_by(c, F.struct((~F.coalesce(valid, F.lit(False))).cast("int").alias("invalid"), *tail, F.coalesce(c, F.lit("")).alias("value"))).alias(c)
    country = F.min_by("country", F.struct(F.when(F.col("country").isNotNull(), F.col("p")).otherwise(99).alias("invalid"), "t", "p", "source_key", F.coalesce("country", F.lit("")).alias("value")))
    return rows.groupBy(F.col("customer_id").alias("address_id"), "customer_id", "file_date").agg(
        best("street", F.length(F.trim("street")) >= 5),
        best("city", F.col("city").isNotNull()),
        best("postal_code", F.col("postal_code").isNotNull()),
        country.alias("country"),
        F.max("row_timestamp").alias("row_timestamp"),
    )


