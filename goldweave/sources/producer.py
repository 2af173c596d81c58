"""Synthetic events: random ones from a seed, or the replay of feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import FEEDS, TOPICS

_FIRST = ("Ann", "Bill", "Carla", "David", "Elena", "Frank", "Grace", "Hugo")
_LAST = ("Adler", "Brooks", "Castro", "Dubois", "Evans", "Fischer", "Garcia", "Hansen")


def _pick(values: tuple[str, ...], seed: int, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def random_events(spark: SparkSession, count: int, seed: int = 0, keys: int = 90_000) -> DataFrame:
    """topic, key, ts, arrival and payload of that many events, the same for the same seed, made in parallel."""
    rows = spark.range(count).withColumn("n", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(9)), F.lit(keys)) + 10_000)
    first, last = _pick(_FIRST, seed, 1), _pick(_LAST, seed, 2)
    mail = F.lower(F.concat(first, F.lit("."), last, F.col("n").cast("string"), F.lit("@example.com")))
    phone = F.concat(F.lit("+1 415 "), F.lpad((F.col("n") * 37 % 10_000_000).cast("string"), 7, "0"))
    values = {"first_name": first, "last_name": last, "email": mail, "phone": phone, "name": F.concat_ws(" ", first, last)}
    alike = {"email_address": "email", "callback_email": "email", "mobile": "phone", "callback_phone": "phone", "caller_name": "name"}
    out = []
    for i, (topic, (system, fields)) in enumerate(TOPICS.items()):
        key = F.concat(F.lit(system[-1]), F.col("n").cast("string"))
        payload = F.to_json(F.struct(key.alias(fields[0]), *[values[alike.get(f, f)].alias(f) for f in fields[1:]]))
        out.append((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), F.lit(len(TOPICS))) == i, topic, key, payload))
    pick = lambda at: reduce(lambda rest, o: F.when(o[0], F.lit(o[at]) if at == 1 else o[at]).otherwise(rest), out, F.lit(None).cast("string"))
    return rows.select(pick(1).alias("topic"), pick(2).alias("key"), (F.col("id") + 1_700_000_000).alias("ts"), F.col("id").alias("arrival"), pick(3).alias("payload"))


def replay(feeds: dict[str, DataFrame], start: int = 0) -> DataFrame:
    """The rows of customer feeds (crm_a_customers, ...) as events, in the order of feed and key, a second apart by feed."""
    out = []
    for i, (topic, (system, fields)) in enumerate(TOPICS.items()):
        feed = f"crm_{system[-1].lower()}_customers"
        if feed in feeds:
            payload = F.to_json(F.struct(*[F.col(f) for f in FEEDS[feed]]))
            arrival = F.xxhash64(F.lit(i), "_source_file", *FEEDS[feed]).bitwiseAND((1 << 62) - 1)
            out.append(feeds[feed].select(F.lit(topic).alias("topic"), F.col(fields[0]).alias("key"), F.lit(start + i).cast("long").alias("ts"), arrival.alias("arrival"), payload.alias("payload")))
    return reduce(DataFrame.unionByName, out)
