"""Clusters of matched records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import cut
from .components import connected_components
from .ids import numbered

_LABEL = "concat(source_system, '|', source_key)"


def onehop(records: DataFrame, found: DataFrame) -> DataFrame:
    """Each record with the least first end of its matches, or its own label: not transitive.

    With links A-B and B-C only, A and B get A, and C gets B.
    """
    label = F.concat("source_a", F.lit("|"), "key_a")
    ends = found.select(F.explode(F.array(F.struct(F.col("source_a").alias("source_system"), F.col("key_a").alias("source_key")), F.struct(F.col("source_b").alias("source_system"), F.col("key_b").alias("source_key")))).alias("end"), label.alias("label"))
    least = ends.groupBy("end.source_system", "end.source_key").agg(F.min("label").alias("label"))
    keys = records.select("source_system", "source_key").distinct()
    return keys.join(least, ["source_system", "source_key"], "left").select("source_system", "source_key", F.coalesce("label", F.expr(_LABEL)).alias("cluster_id"))


def transitive(records: DataFrame, found: DataFrame) -> DataFrame:
    """Each record with the least label of all that it is linked with, directly or not."""
    edges = found.select(F.concat("source_a", F.lit("|"), "key_a").alias("a"), F.concat("source_b", F.lit("|"), "key_b").alias("b"))
    labels = connected_components(edges, cut)
    keys = records.select("source_system", "source_key").distinct().withColumn("node", F.expr(_LABEL))
    return keys.join(labels, "node", "left").select("source_system", "source_key", F.coalesce("component", "node").alias("cluster_id"))


def with_ids(clusters: DataFrame) -> DataFrame:
    """clusters with customer_id: the dense rank of the label."""
    ids = numbered(clusters.select("cluster_id").distinct(), ["cluster_id"], "customer_id")
    return clusters.join(ids, "cluster_id").select("customer_id", "source_system", "source_key", "cluster_id")


def first_seen_ids(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """clusters with customer_id in the order of each cluster's first event (ts, then key)."""
    first = clusters.join(records.select("source_system", "source_key", "ts"), ["source_system", "source_key"]).groupBy("cluster_id").agg(F.min(F.struct("ts", "source_system", "source_key")).alias("first"))
    order = first.select("cluster_id", F.col("first.ts").alias("_ts"), F.col("first.source_system").alias("_system"), F.col("first.source_key").alias("_key"))
    ids = numbered(order, ["_ts", "_system", "_key"], "customer_id").select("cluster_id", "customer_id")
    return clusters.join(ids, "cluster_id").select("customer_id", "source_system", "source_key", "cluster_id")


def merge_into(members: DataFrame, links: DataFrame) -> DataFrame:
    """Membership (source_system, source_key, cluster_id) after linking records: clusters that a link joins become the largest of them, the smallest id among equals.

    links has source_a, key_a, source_b, key_b; records without a cluster yet are not given one here.
    """
    at = lambda side: members.select(F.col("source_system").alias(f"source_{side}"), F.col("source_key").alias(f"key_{side}"), F.col("cluster_id").alias(side))
    edges = links.join(at("a"), ["source_a", "key_a"]).join(at("b"), ["source_b", "key_b"]).select("a", "b").where("a <> b")
    groups = connected_components(edges, cut)
    sizes = members.groupBy(F.col("cluster_id").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    winner = groups.join(sizes, "node").groupBy("component").agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("winner"))
    moved = groups.join(winner, "component").select(F.col("node").alias("cluster_id"), "winner")
    return members.join(moved, "cluster_id", "left").select("source_system", "source_key", F.coalesce("winner", "cluster_id").alias("cluster_id"))
