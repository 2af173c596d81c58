"""The event engine: each micro-batch turns a versioned snapshot into the next and writes change events.

Tables live in folders named by batch. A batch reads the snapshot of the last batch that was finished before it, writes
its own tables, and is finished by an empty marker file. A batch that ran before is left as it is, and one that broke off
is written anew, so that repeats after a failure change nothing. Change events are written before the marker, so they
stand for a state that is there whenever they are seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NRT, MdmConfig
from ..functions.text import initcap
from ..operators import admin, blocking, history, matching, normalize, quality, survivorship
from ..operators.cluster import merge_into
from ..operators.ids import numbered
from ..plans.mdm import LatestPlan
from .engine import parsed, split_parsed

_KEYS = ["source_system", "source_key"]
_RECORD = "source_system string, source_key string, first_name string, last_name string, email string, phone string, ts long, arrival long"
_GOLDEN = ("first_name", "last_name", "email", "phone", "dq_score", "source_count")
SCHEMAS = {
    "records": _RECORD,
    "members": "source_system string, source_key string, cluster_id long",
    "golden": "customer_id long, first_name string, last_name string, email string, phone string, dq_score int, source_count int, row_hash string, valid_from timestamp, valid_to timestamp, is_current boolean",
    "suppressions": "source_system_a string, source_key_a string, source_system_b string, source_key_b string, reason string, created_by string",
}


@dataclass
class EventEngine:
    """folder is in any store that Spark writes to; suppressions is a table of pairs kept apart from the start, to which unmatch() adds."""

    spark: SparkSession
    folder: str
    config: MdmConfig = NRT
    suppressions: DataFrame | None = None

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def finished(self) -> list[int]:
        """Batches with a marker, in order."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.folder}/*/_DONE")) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def table(self, name: str, batch: int | None = None) -> DataFrame:
        """A table of the snapshot after a batch, by default the last; empty before the first."""
        done = self.finished()
        batch = done[-1] if batch is None and done else batch
        if batch is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.folder}/{batch}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{batch}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, events: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        self.process(events, batch)

    def _before(self, batch: int) -> dict[str, DataFrame]:
        """The tables that a batch starts from; the suppressions of the start are part of them."""
        before = max((b for b in self.finished() if b < batch), default=None)
        old = {n: self.table(n, before) if before is not None else self.spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
        if before is None and self.suppressions is not None:
            names = [c.split()[0] for c in SCHEMAS["suppressions"].split(", ")]
            given = self.suppressions.select(*[F.col(c) if c in self.suppressions.columns else F.lit(None).cast("string").alias(c) for c in names])
            old["suppressions"] = old["suppressions"].unionByName(given)
        return old

    def _advance(self, batch: int, old: dict[str, DataFrame], records: DataFrame, members: DataFrame, suppressions: DataFrame, touched: DataFrame, at: Column | None, audits: list[DataFrame]) -> DataFrame:
        """Write what follows from a batch's records and members: golden versions, change events, audit rows, and the marker. audits are rows for actions of the batch's own."""
        suppressions = self._write(suppressions, "suppressions", batch)
        moved = self._write(history.reassignments(old["members"], members), "xref", batch)
        changed = members.join(touched, _KEYS, "left_semi").select("cluster_id").union(moved.select("cluster_id")).union(moved.where("previous_cluster_id is not null").select("previous_cluster_id")).distinct()
        groups = members.join(changed, "cluster_id", "left_semi").withColumnRenamed("cluster_id", "customer_id")
        rows = survivorship.golden_latest(groups, records, self.config)
        scored = self._write(quality.scored(rows, quality.customer_rules(self.config)).select("customer_id", *_GOLDEN, "ts"), "recomputed", batch)
        at = F.timestamp_seconds(F.lit(scored.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0])) if at is None else at
        kept = history.apply_snapshot(old["golden"], scored, _GOLDEN, at)
        gone = changed.withColumnRenamed("cluster_id", "customer_id").join(scored, "customer_id", "left_anti").withColumn("_gone", F.lit(True))
        kept = kept.join(gone, "customer_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)) & F.col("is_current"))
        kept = kept.withColumn("valid_to", F.when(F.col("_gone"), at).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~F.col("_gone")).drop("_gone")
        golden = self._write(kept.select(*[c.split()[0] for c in SCHEMAS["golden"].split(", ")]), "golden", batch)
        ids = changed.withColumnRenamed("cluster_id", "customer_id")
        cdc = history.changes(old["golden"].where("is_current").join(ids, "customer_id", "left_semi"), golden.where("is_current").join(ids, "customer_id", "left_semi"))
        cdc = self._write(cdc.where("row_hash is not null or previous_hash is not null"), "cdc", batch)
        outcome = touched.join(members, _KEYS).join(cdc.select(F.col("customer_id").alias("cluster_id"), "event_type"), "cluster_id", "left").withColumn("action", F.coalesce("event_type", F.lit("NO_CHANGE")))
        merged = moved.where("event_type = 'REASSIGN'").withColumn("action", F.lit("MERGE"))
        said = reduce(DataFrame.unionByName, [x.select(*_KEYS, "cluster_id", "action") for x in (outcome, *(() if audits else (merged,)))])
        detail = F.to_json(F.struct(F.lit(batch).alias("batch")))
        told = admin.audit_rows(said, "EVENT", F.col("action"), "stream", detail, at)
        for rows in audits:
            told = told.unionByName(rows if "event_id" in rows.columns else admin.audit_rows(rows, "EVENT", F.col("action"), "stream", F.coalesce("detail", detail), at))
        self._write(told, "audit", batch)
        fs, path = self._fs()
        fs.create(path(f"{self.folder}/{batch}/_DONE"), True).close()
        return cdc

    def process(self, events: DataFrame, batch: int) -> DataFrame:
        """Take a batch of events (topic, key, ts, arrival, payload) into the state; gives its change events.

        Several events for one cluster in a batch make one golden version. Events that can't be taken are quarantined and
        told of as ERROR; late ones as SKIPPED.
        """
        if batch in self.finished():
            return self.table("cdc", batch)
        old = self._before(batch)
        good, bad = split_parsed(self._write(parsed(events), "parsed", batch), events.columns)  # the events are read once
        bad = self._write(bad, "quarantine", batch)
        stored = old["records"].withColumn("arrival", F.lit(-1).cast("long"))  # before all of the batch
        both = self._write(stored.unionByName(good), "incoming", batch)
        late = normalize.skipped(both).where("arrival >= 0")
        records = self._write(normalize.latest(both), "records", batch)
        touched = records.where("arrival >= 0").select(*_KEYS).distinct()
        fresh = touched.join(old["members"], _KEYS, "left_anti")
        top = old["members"].agg(F.coalesce(F.max("cluster_id"), F.lit(0))).first()[0]
        new = numbered(fresh, _KEYS, "cluster_id").withColumn("cluster_id", F.col("cluster_id") + top)
        members = self._write(old["members"].unionByName(new), "assigned", batch)
        base = blocking.match_base(records.withColumn("canonical_first_name", initcap(F.col("first_name"))).withColumn("is_fake_name", F.lit(False)))
        links = matching.unsuppressed(matching.matches(base, self.config, touched), old["suppressions"])
        members = self._write(merge_into(members, links), "members", batch)
        moved = history.reassignments(old["members"], members).where("event_type = 'REASSIGN'")
        nothing = F.lit(None).cast("string").alias("detail")
        audits = [
            moved.select(*_KEYS, "cluster_id", F.lit("MERGE").alias("action"), nothing),
            late.select(*_KEYS, F.lit(None).cast("long").alias("cluster_id"), F.lit("SKIPPED").alias("action"), nothing),
            bad.select(F.col("topic").alias("source_system"), F.col("key").alias("source_key"), F.lit(None).cast("long").alias("cluster_id"), F.lit("ERROR").alias("action"), F.to_json(F.struct("reason", "arrival")).alias("detail")),
        ]
        return self._advance(batch, old, records, members, old["suppressions"], touched, None, audits)

    def rebuild(self, batch: int, records: DataFrame | None = None) -> DataFrame:
        """Resolve all records anew, by default those that are stored, and number the clusters from 1; gives the change events.

        records (source_system, source_key, names, email, phone, ts) are a first load, or replace what is stored. Suppressed
        pairs stay apart and the history of golden records is kept. The audit tells of it as TRUNCATE_AND_REBUILD.
        """
        if batch in self.finished():
            return self.table("cdc", batch)
        old = self._before(batch)
        rows = (old["records"] if records is None else records).select(*[c.split()[0] for c in _RECORD.split(", ") if not c.startswith("arrival")])
        records = self._write(normalize.latest(rows.withColumn("arrival", F.lit(-1).cast("long"))), "records", batch)
        plan = LatestPlan(self.spark, records.drop("arrival"), self.config, None if old["suppressions"].isEmpty() else old["suppressions"])
        members = self._write(plan.groups.select(*_KEYS, F.col("customer_id").alias("cluster_id")), "members", batch)
        none = self.spark.createDataFrame([(None, None, None)], "source_system string, source_key string, cluster_id long")
        at = F.timestamp_seconds(F.lit(records.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]))
        told = admin.audit_rows(none, "ADMIN", F.lit("TRUNCATE_AND_REBUILD"), "batch", F.to_json(F.struct(F.lit(batch).alias("batch"))), at)
        gone = old["members"].select(F.col("cluster_id")).distinct()
        whole = records.select(*_KEYS)
        closed = old["golden"].where("is_current").join(gone.withColumnRenamed("cluster_id", "customer_id"), "customer_id", "left_semi")
        old = old | {"members": old["members"].join(whole, _KEYS, "left_semi")}
        return self._advance(batch, old | {"golden": self._closed(old["golden"], closed, members, at)}, records, members, old["suppressions"], whole, at, [told])

    @staticmethod
    def _closed(golden: DataFrame, open_: DataFrame, members: DataFrame, at: Column) -> DataFrame:
        """golden with the open versions of ids that no member has any longer closed."""
        gone = open_.select("customer_id").join(members.select(F.col("cluster_id").alias("customer_id")), "customer_id", "left_anti").distinct().withColumn("_gone", F.lit(True))
        rows = golden.join(gone, "customer_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)) & F.col("is_current"))
        return rows.withColumn("valid_to", F.when(F.col("_gone"), at).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~F.col("_gone")).drop("_gone").select(*golden.columns)

    def unmatch(self, batch: int, cluster_id: int, split: list[tuple[str, str]], reason: str, actor: str, at: str) -> DataFrame:
        """Take records out of a cluster into a new one: both golden records are made anew, the pairs are suppressed from now on, and the audit tells of it; gives the change events."""
        if batch in self.finished():
            return self.table("cdc", batch)
        old = self._before(batch)
        done = admin.unmatch(old["members"], cluster_id, split, reason, actor, at)
        records = self._write(old["records"], "records", batch)
        members = self._write(done.members, "members", batch)
        suppressions = old["suppressions"].unionByName(done.suppressions)
        touched = members.where(F.col("cluster_id").isin(cluster_id, done.new_cluster_id)).select(*_KEYS)
        return self._advance(batch, old, records, members, suppressions, touched, F.lit(at).cast("timestamp"), [done.audit])

    def start(self, events: DataFrame, checkpoint: str):
        """Run a stream of events through the engine until all that is there is read."""
        return events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
