"""Views over golden records, and the read API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .admin import audit_rows
from .ids import numbered
from .quality import tier


def xref(groups: DataFrame, id_column: str) -> DataFrame:
    """Numbered cross-references from source records to golden ids."""
    rows = groups.select(id_column, "source_system", "source_key").distinct()
    return numbered(rows, [id_column, "source_system", "source_key"], "xref_id").select("xref_id", id_column, "source_system", "source_key")


_PLACE = ("address_id", "address_type", "street", "city", "postal_code", "country", "is_primary", "dq_score")


def customer_360(customers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each customer with the primary address and all addresses as an array of objects."""
    primary = lambda c: F.max(F.when(F.col("is_primary"), F.col(c)))
    fields = [F.col(c).alias("type" if c == "address_type" else c) for c in _PLACE]
    gathered = addresses.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("address_count"),
        primary("street").alias("primary_street"),
        primary("city").alias("primary_city"),
        primary("postal_code").alias("primary_postal_code"),
        primary("country").alias("primary_country"),
        primary("dq_score").alias("primary_address_dq_score"),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("all_addresses"),
    )
    out = customers.join(gathered, "customer_id", "left")
    return out.withColumns(
        {
            "full_name": F.concat("first_name", F.lit(" "), "last_name"),
            "dq_tier": tier(F.col("dq_score")),
            "address_count": F.coalesce("address_count", F.lit(0)),
            "primary_address_full": F.concat_ws(", ", "primary_street", "primary_city", "primary_postal_code", "primary_country"),
        }
    )


def customer_360_flat(customers: DataFrame, addresses: DataFrame) -> DataFrame:
    """A row for each customer and address."""
    places = addresses.select("customer_id", *_PLACE).withColumnRenamed("dq_score", "address_dq_score")
    return customers.withColumn("dq_tier", tier(F.col("dq_score"))).join(places, "customer_id", "left")


def search(customers: DataFrame, addresses: DataFrame, text: str, tiers: tuple[str, ...] = ()) -> DataFrame:
    """Customers with a text in their names, e-mail, id, street, city or country, of the given tiers."""
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    there = addresses.where(has("street") | has("city") | has("country")).select("customer_id").distinct().withColumn("_there", F.lit(True))
    found = customers.withColumn("dq_tier", tier(F.col("dq_score"))).join(there, "customer_id", "left")
    found = found.where(has("first_name") | has("last_name") | has("email") | has("customer_id") | F.coalesce("_there", F.lit(False))).drop("_there")
    return found.where(F.col("dq_tier").isin(*tiers)) if tiers else found


def get_customer(history: DataFrame, customer_id: int) -> DataFrame:
    return history.where((F.col("customer_id") == customer_id) & F.col("is_current"))


def get_sources(groups: DataFrame, records: DataFrame, customer_id: int) -> DataFrame:
    return groups.where(F.col("customer_id") == customer_id).join(records, ["source_system", "source_key"])


def get_history(history: DataFrame, customer_id: int) -> DataFrame:
    return history.where(F.col("customer_id") == customer_id).orderBy(F.desc("valid_from"))


def cluster_ids(members: DataFrame, keys: DataFrame) -> DataFrame:
    """source_system, source_key and cluster_id of the records named by keys; one without a cluster is left out."""
    return members.join(keys.select("source_system", "source_key").distinct(), ["source_system", "source_key"])


def health(golden: DataFrame) -> DataFrame:
    """One row: status, and how many customers are current."""
    return golden.where("is_current").agg(F.count(F.lit(1)).alias("customers")).select(F.lit("ok").alias("status"), "customers")


def read_audit(rows: DataFrame, path: str, at: str, actor: str = "rest:read") -> DataFrame:
    """An audit row for each customer (customer_id) that a read gave."""
    read = rows.select(F.lit(None).cast("string").alias("source_system"), F.lit(None).cast("string").alias("source_key"), F.col("customer_id").alias("cluster_id")).distinct()
    return audit_rows(read, "READ", F.lit("READ"), actor, F.to_json(F.struct(F.concat(F.lit(f"{path}/"), F.col("cluster_id").cast("string")).alias("path"))), F.lit(at).cast("timestamp"))


def audit_query(audit: DataFrame, limit: int = 100, **equal: str) -> DataFrame:
    """The newest audit rows with the given values."""
    for column, value in equal.items():
        audit = audit.where(F.col(column) == value)
    return audit.orderBy(F.desc("created_at"), "event_id").limit(limit)
