"""Readers of raw feeds and events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import BULK, MdmConfig
from ..functions.text import null_tokens

#: Positional columns of the six feeds; all are strings.
FEEDS = {
    "crm_a_customers": ("src_customer_id", "first_name", "last_name", "email", "phone"),
    "crm_b_customers": ("customer_key", "name", "email_address", "mobile"),
    "crm_c_customers": ("ticket_customer_id", "caller_name", "callback_email", "callback_phone"),
    "crm_a_addresses": ("src_address_id", "src_customer_id", "street", "city", "postal_code", "country"),
    "crm_b_addresses": ("addr_id", "customer_key", "address_line", "city", "zip", "country_code"),
    "crm_c_addresses": ("addr_ref", "ticket_customer_id", "location", "town", "postcode", "country"),
}
#: Fields of the events of each topic; the first is the key.
TOPICS = {"topic.crm.a": ("CRM_A", FEEDS["crm_a_customers"]), "topic.crm.b": ("CRM_B", FEEDS["crm_b_customers"]), "topic.crm.c": ("CRM_C", FEEDS["crm_c_customers"])}


def feed_schema(feed: str, corrupt: bool = False) -> StructType:
    return StructType([StructField(c, StringType()) for c in (*FEEDS[feed], *(("_corrupt_record",) if corrupt else ()))])


def tokens_of(system: str, config: MdmConfig = BULK) -> tuple[str, ...]:
    return config.null_tokens + dict(config.source_null_tokens).get(system, ())


def clear_tokens(raw: DataFrame, system: str, config: MdmConfig = BULK) -> DataFrame:
    """Null tokens of the system's files become nulls in every column but the file's name."""
    return raw.select(*[c if c == "_source_file" else null_tokens(F.col(c), tokens_of(system, config)).alias(c) for c in raw.columns])


def read_feed(spark: SparkSession, feed: str, path: str, config: MdmConfig = BULK, stream: bool = False, keep_bad: bool = False) -> DataFrame:
    """A feed's CSV files by position, with their file name. Rows that don't parse are skipped, or kept in _corrupt_record."""
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(feed_schema(feed, keep_bad)).option("header", True).option("enforceSchema", True).option("quote", '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED")
    raw = reader.csv(path).withColumn("_source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return clear_tokens(raw, f"CRM_{feed[4].upper()}", config)


def append_feed(raw: DataFrame, table: str, checkpoint: str):
    """Load what is new in a feed's folder into a table, once; the checkpoint keeps what was loaded."""
    return raw.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(table)


def read_events(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of events (topic, key, ts, arrival, payload) from JSON files."""
    reader = spark.readStream.schema("topic string, key string, ts long, arrival long, payload string")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def read_kafka(spark: SparkSession, servers: str, topics: tuple[str, ...] = tuple(TOPICS)) -> DataFrame:
    """The same columns from Kafka; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return raw.select("topic", F.col("key").cast("string"), F.unix_seconds("timestamp").alias("ts"), F.col("offset").alias("arrival"), F.col("value").cast("string").alias("payload"))
