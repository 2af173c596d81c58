"""Splitting wrongly merged clusters, and suppressions that keep them apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What audit rows can tell of.
ACTIONS = ("INSERT", "UPDATE", "MERGE", "NO_CHANGE", "SKIPPED", "ERROR", "READ", "UNMATCH", "TRUNCATE", "TRUNCATE_AND_REBUILD")


class UnmatchError(ValueError):
    """An unknown cluster, a record that isn't in it, or a split that would leave it empty."""


@dataclass
class Split:
    members: DataFrame
    suppressions: DataFrame
    reassigned: DataFrame
    audit: DataFrame
    new_cluster_id: int


def audit_rows(rows: DataFrame, event_type: str, action: Column, actor: str, detail: Column, created_at: Column) -> DataFrame:
    """Audit rows for rows with source_system, source_key and cluster_id; the id is made of what they tell, so that a repeat gives the same."""
    out = rows.select(F.lit(event_type).alias("event_type"), F.lit(actor).alias("actor"), "source_system", "source_key", F.col("cluster_id"), action.alias("action"), detail.alias("detail"), created_at.alias("created_at"))
    return out.withColumn("event_id", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def unmatch(members: DataFrame, cluster_id: int, split: list[tuple[str, str]], reason: str, actor: str, at: str) -> Split:
    """Take records out of a cluster into a new one and suppress their matches with those that stay.

    members has source_system, source_key, cluster_id (long). split is the caller's short list of records.
    """
    spark = members.sparkSession
    gone = F.broadcast(spark.createDataFrame(sorted(set(split)), "source_system string, source_key string"))  # as many as the caller names
    cluster = members.where(F.col("cluster_id") == cluster_id)
    counts = cluster.join(gone.withColumn("_gone", F.lit(1)), ["source_system", "source_key"], "left").agg(F.count(F.lit(1)), F.count("_gone")).first()
    if counts[0] == 0:
        raise UnmatchError(f"cluster {cluster_id} is unknown")
    if counts[1] != len(set(split)):
        raise UnmatchError("a record is not in the cluster")
    if counts[0] == counts[1]:
        raise UnmatchError("a record must stay in the cluster")
    new = members.agg(F.max("cluster_id")).first()[0] + 1
    mark = gone.withColumn("_gone", F.lit(True))
    marked = members.join(mark, ["source_system", "source_key"], "left").withColumn("_moved", F.coalesce("_gone", F.lit(False)) & (F.col("cluster_id") == cluster_id))
    after = marked.select("source_system", "source_key", F.when(F.col("_moved"), new).otherwise(F.col("cluster_id")).cast("long").alias("cluster_id"))
    stay = cluster.join(gone, ["source_system", "source_key"], "left_anti").select(F.struct("source_system", "source_key").alias("y"))
    moved = spark.createDataFrame(sorted(set(split)), "source_system string, source_key string").select(F.struct("source_system", "source_key").alias("x"))
    pairs = stay.join(F.broadcast(moved), F.lit(True)).select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("h"))  # the named records against one cluster's
    suppressions = pairs.select(
        F.col("l.source_system").alias("source_system_a"), F.col("l.source_key").alias("source_key_a"), F.col("h.source_system").alias("source_system_b"), F.col("h.source_key").alias("source_key_b"), F.lit(reason).alias("reason"), F.lit(actor).alias("created_by")
    )
    reassigned = marked.where("_moved").select("source_system", "source_key", F.lit(new).cast("long").alias("cluster_id"), F.lit(cluster_id).cast("long").alias("previous_cluster_id"), F.lit("REASSIGN").alias("event_type"))
    audit = audit_rows(reassigned, "ADMIN", F.lit("UNMATCH"), actor, F.to_json(F.struct(F.lit(reason).alias("reason"), F.lit(cluster_id).alias("from"))), F.lit(at).cast("timestamp"))
    return Split(after, suppressions, reassigned, audit, new)
