"""Sinks of change events: JSON files or Kafka, with the keys and fields that consumers expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The topics of golden records and of cross-references.
GOLDEN_TOPIC, XREF_TOPIC = "topic.mdm.golden", "topic.mdm.xref"
_FIELDS = ("first_name", "last_name", "email", "phone", "dq_score", "source_count")


def _messages(rows: DataFrame, topic: str, key: Column, fields: list[Column]) -> DataFrame:
    return rows.select(F.lit(topic).alias("topic"), key.alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def golden_messages(cdc: DataFrame, golden: DataFrame, published_at: str) -> DataFrame:
    """topic, key (the customer's id) and value (JSON) of golden records that are new, changed or closed."""
    now = golden.where("is_current").select("customer_id", *_FIELDS)
    rows = cdc.where("event_type <> 'NO_CHANGE'").join(now, "customer_id", "left")
    fields = [F.col(c) for c in ("customer_id", "event_type", *_FIELDS, "row_hash", "previous_hash")]
    return _messages(rows, GOLDEN_TOPIC, F.col("customer_id").cast("string"), [*fields, F.col("valid_from").cast("string").alias("valid_from"), F.lit(published_at).alias("published_at")])


def xref_messages(xref: DataFrame, published_at: str) -> DataFrame:
    """topic, key (system and key) and value (JSON) of records that are assigned to a customer or move to another."""
    fields = [F.col("source_system"), F.col("source_key"), F.col("cluster_id").alias("customer_id"), F.col("event_type"), F.col("previous_cluster_id").alias("previous_customer_id"), F.lit(published_at).alias("published_at")]
    return _messages(xref, XREF_TOPIC, F.concat_ws("|", "source_system", "source_key"), fields)


def publish(messages: DataFrame, folder: str | None = None, servers: str | None = None) -> None:
    """Append messages to JSON files by topic in a folder, or send them to Kafka, which needs Spark's connector."""
    if servers:
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        messages.write.mode("append").partitionBy("topic").json(folder)
