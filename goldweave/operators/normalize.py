"""Harmonise the feeds of three systems into one customer and one address schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BULK, MdmConfig
from ..functions import text as T

#: For each system: columns of key, first name, last name, whole name, e-mail and phone.
CUSTOMERS = {
    "CRM_A": ("src_customer_id", "first_name", "last_name", None, "email", "phone"),
    "CRM_B": ("customer_key", None, None, "name", "email_address", "mobile"),
    "CRM_C": ("ticket_customer_id", None, None, "caller_name", "callback_email", "callback_phone"),
}
#: For each system: columns of key, customer's key, street, city, postal code and country.
ADDRESSES = {
    "CRM_A": ("src_address_id", "src_customer_id", "street", "city", "postal_code", "country"),
    "CRM_B": ("addr_id", "customer_key", "address_line", "city", "zip", "country_code"),
    "CRM_C": ("addr_ref", "ticket_customer_id", "location", "town", "postcode", "country"),
}


def _capital(x: Column, mode: str) -> Column:
    return T.initcap(F.trim(T.blank_to_null(x))) if mode == "nrt" else T.initcap(x)


def customer_columns(system: str, config: MdmConfig = BULK) -> dict[str, Column]:
    """The common schema's columns, but for the system, as expressions over one system's fields."""
    key, first, last, name, email, phone = CUSTOMERS[system]
    first = F.col(first) if first else T.first_word(F.col(name))
    last = F.col(last) if last else T.other_words(F.col(name))
    return {"source_key": F.col(key), "first_name": _capital(first, config.mode), "last_name": _capital(last, config.mode), "email": T.email(F.col(email), config.mode), "phone": T.phone(F.col(phone), config.mode)}


def map_customer(raw: DataFrame, system: str, config: MdmConfig = BULK, keep: tuple[str, ...] = ()) -> DataFrame:
    """One system's customers in the common schema; keep names further columns that stay."""
    return raw.select(F.lit(system).alias("source_system"), *[c.alias(n) for n, c in customer_columns(system, config).items()], *keep)


def customer_union(raws: dict[str, DataFrame], config: MdmConfig = BULK) -> DataFrame:
    """All versions of all systems' customers, with the date of their file, which is also their time."""
    parts = [map_customer(raw, system, config, ("_source_file",)) for system, raw in raws.items()]
    union = reduce(DataFrame.unionByName, parts).withColumn("file_date", T.file_date(F.col("_source_file")))
    return union.withColumn("row_timestamp", F.col("file_date").cast("timestamp")).drop("_source_file")


def address_union(raws: dict[str, DataFrame]) -> DataFrame:
    """All versions of all systems' addresses."""
    parts = []
    for system, raw in raws.items():
        key, customer, street, city, postal, country = (F.col(c) for c in ADDRESSES[system])
        parts.append(
            raw.select(
                F.lit(system).alias("source_system"),
                key.alias("source_key"),
                customer.alias("source_customer_key"),
                T.initcap(F.trim(street)).alias("street"),
                T.initcap(F.trim(city)).alias("city"),
                F.upper(F.trim(postal)).alias("postal_code"),
                F.upper(F.trim(country)).alias("country"),
                T.file_date(F.col("_source_file")).alias("file_date"),
            )
        )
    return reduce(DataFrame.unionByName, parts).withColumn("row_timestamp", F.col("file_date").cast("timestamp"))


def latest(records: DataFrame, keys: tuple[str, ...] = ("source_system", "source_key"), time: str = "ts", arrival: str = "arrival") -> DataFrame:
    """The row of each key that an upsert with a guard against late rows leaves: the newest, the last to arrive among equals."""
    rest = [c for c in records.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(time, arrival))
    return records.groupBy(*keys).agg(row.alias("row")).select(*keys, *[F.col(f"row.{c}") for c in rest])


def skipped(records: DataFrame, keys: tuple[str, ...] = ("source_system", "source_key"), time: str = "ts", arrival: str = "arrival") -> DataFrame:
    """Rows that came after a newer row of their key, and so are rejected."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("_newest", F.max(time).over(before)).where(F.col(time) < F.col("_newest")).drop("_newest")


def too_long(records: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with a value over its column's length limit, as Spark does not hold VARCHAR lengths."""
    over = reduce(lambda a, b: a | b, [F.length(c) > n for c, n in limits.items()])
    return records.where(over)
