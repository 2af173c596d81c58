"""Events: parsing with quarantine, a stateful gate against late rows, and the micro-batch engine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import NRT
from ..operators import normalize
from ..sources.readers import TOPICS, read_events
from ..sources.session import shared_folder

COLUMNS = ("source_system", "source_key", "first_name", "last_name", "email", "phone", "ts", "arrival")
_ROW = "source_system string, source_key string, first_name string, last_name string, email string, phone string, ts long, arrival long"


def parsed(events: DataFrame) -> DataFrame:
    """Events with the columns of the common schema and a reason where they are to be quarantined: unknown topic, malformed payload, or no key. One pass, and one parse of each payload."""
    fields = dict.fromkeys(f for _, names in TOPICS.values() for f in names)
    schema = ", ".join(f"{c} string" for c in (*fields, "_corrupt_record"))
    known = F.coalesce(F.col("topic").isin(*TOPICS), F.lit(False))
    read = F.when(known, F.from_json("payload", schema, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    own = [c for c in events.columns if c not in fields]
    flat = events.select(*own, read.alias("_fields")).select(*own, F.col("_fields").isNull().alias("_none"), F.col("_fields._corrupt_record").alias("_broken"), *[F.col(f"_fields.{c}").alias(c) for c in fields])
    by_topic = {topic: (system, normalize.customer_columns(system, NRT)) for topic, (system, _) in TOPICS.items()}
    pick = lambda f: reduce(lambda out, t: F.when(F.col("topic") == t, f(*by_topic[t])).otherwise(out), by_topic, F.lit(None).cast("string"))
    columns = {"source_system": pick(lambda system, _: F.lit(system))} | {c: pick(lambda _, found, c=c: found[c]) for c in COLUMNS[1:6]}
    why = F.when(~known, "unknown topic").when(F.col("_none") | F.col("_broken").isNotNull(), "malformed payload").when(F.coalesce("source_key", F.lit("")) == "", "no key")
    rows = flat.select(*own, "_none", "_broken", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumn("reason", why).drop("_none", "_broken")


def split_parsed(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows in the common schema, and quarantined events with their own columns and the reason."""
    return rows.where("reason is null").select(*COLUMNS), rows.where("reason is not null").select(*columns, "reason")


def parse(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined events; see parsed()."""
    return split_parsed(parsed(events), events.columns)


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    newest = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
    before = rows["ts"].cummax().shift(fill_value=rows["ts"].min() if newest is None else newest)
    before = before if newest is None else before.clip(lower=newest)
    state.update((int(max(rows["ts"].max(), before.max())),))
    yield rows.assign(outcome=(rows["ts"] < before).map({True: "SKIPPED", False: "ACCEPTED"}))[[*COLUMNS, "outcome"]]


def gate(good: DataFrame) -> DataFrame:
    """Rows of a stream with an outcome: SKIPPED if a newer row of their key came before, else ACCEPTED. The state is a time for each key."""
    return good.groupBy("source_system", "source_key").applyInPandasWithState(_gate, f"{_ROW}, outcome string", "newest long", "append", GroupStateTimeout.NoTimeout)


def run_gate(events: DataFrame) -> DataFrame:
    """Write events as JSON files, run them as a stream through the gate until all are read, and give each key's last accepted row."""
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/gate-{uuid.uuid4().hex}"
    events.write.json(f"{folder}/events")
    good = gate(parse(read_events(spark, f"{folder}/events"))[0])
    good.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{_ROW}, outcome string").parquet(f"{folder}/rows").where("outcome = 'ACCEPTED'")
    rest = [c for c in COLUMNS if c not in ("source_system", "source_key")]
    last = rows.groupBy("source_system", "source_key").agg(F.max_by(F.struct(*rest), F.struct("ts", "arrival")).alias("row"))
    return last.select("source_system", "source_key", "row.*")
