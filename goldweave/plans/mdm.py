"""The whole engine as a lazy plan: each table is a function of those before, made once for each plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BULK, NRT, MdmConfig
from ..operators import blocking, cluster, enrich, history, matching, normalize, quality, serving, survivorship
from ..sources import fixtures
from ..sources.readers import clear_tokens
from ..sources.session import cut, ship


@dataclass
class MdmPlan:
    """Bulk tables of raw feeds: raws and addresses by system. variant is "fuzzy" or "ai"."""

    spark: SparkSession
    raws: dict[str, DataFrame]
    addresses: dict[str, DataFrame]
    config: MdmConfig = BULK
    variant: str = "fuzzy"
    suppressions: DataFrame | None = field(default=None)

    @cached_property
    def customer_union(self) -> DataFrame:
        return normalize.customer_union({s: clear_tokens(r, s, self.config) for s, r in self.raws.items()}, self.config)

    @cached_property
    def address_union(self) -> DataFrame:
        return normalize.address_union({s: clear_tokens(r, s, self.config) for s, r in self.addresses.items()})

    @cached_property
    def enriched(self) -> DataFrame:
        return cut(enrich.enrich(self.customer_union, self.variant), "enriched")

    @cached_property
    def base(self) -> DataFrame:
        return cut(blocking.match_base(self.enriched, self.address_union), "base")

    @cached_property
    def matches(self) -> DataFrame:
        found = matching.matches(self.base, self.config)
        return cut(matching.unsuppressed(found, self.suppressions) if self.suppressions is not None else found, "matches")

    @cached_property
    def groups(self) -> DataFrame:
        return cut(cluster.with_ids(_clusters(self)), "groups")

    @cached_property
    def golden(self) -> DataFrame:
        rows = survivorship.golden_bulk(self.groups, self.enriched, self.config)
        return cut(quality.scored(rows, quality.customer_rules(self.config)), "golden")

    @cached_property
    def customers(self) -> DataFrame:
        return history.current(self.golden, "customer_id").withColumnRenamed("row_timestamp", "last_updated").drop("file_date", "is_fake_name")

    @cached_property
    def customer_history(self) -> DataFrame:
        return history.history(self.golden.drop("is_fake_name", "source_count"), "customer_id", history.CUSTOMER)

    @cached_property
    def address_groups(self) -> DataFrame:
        return survivorship.address_groups(self.address_union, self.groups)

    @cached_property
    def golden_addresses(self) -> DataFrame:
        rows = survivorship.golden_addresses(self.address_groups, self.address_union, self.config)
        rows = rows.withColumn("address_type", F.lit("PRIMARY")).withColumn("is_primary", F.lit(True))
        return cut(quality.scored(rows, quality.address_rules()), "addresses")

    @cached_property
    def current_addresses(self) -> DataFrame:
        return history.current(self.golden_addresses, "customer_id").drop("file_date", "row_timestamp")

    @cached_property
    def address_history(self) -> DataFrame:
        return history.history(self.golden_addresses, "customer_id", history.ADDRESS)

    @cached_property
    def customer_xref(self) -> DataFrame:
        return serving.xref(self.groups, "customer_id")

    @cached_property
    def address_xref(self) -> DataFrame:
        return serving.xref(self.address_groups, "address_id")

    @cached_property
    def customer_360(self) -> DataFrame:
        return serving.customer_360(self.customers, self.current_addresses)

    @cached_property
    def customer_360_flat(self) -> DataFrame:
        return serving.customer_360_flat(self.customers, self.current_addresses)


@dataclass
class LatestPlan:
    """Tables of the event-driven engine over records (source_system, source_key, names, email, phone, ts): their latest rows, transitive clusters."""

    spark: SparkSession
    records: DataFrame
    config: MdmConfig = NRT
    suppressions: DataFrame | None = None

    @cached_property
    def base(self) -> DataFrame:
        rows = self.records.withColumn("canonical_first_name", normalize.T.initcap(F.col("first_name"))).withColumn("is_fake_name", F.lit(False))
        return cut(blocking.match_base(rows), "base")

    @cached_property
    def matches(self) -> DataFrame:
        found = matching.matches(self.base, self.config)
        return cut(matching.unsuppressed(found, self.suppressions) if self.suppressions is not None else found, "matches")

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(_clusters(self), "clusters")

    @cached_property
    def groups(self) -> DataFrame:
        return cut(cluster.first_seen_ids(self.clusters, self.records), "groups")

    @cached_property
    def golden(self) -> DataFrame:
        rows = survivorship.golden_latest(self.groups, self.records, self.config)
        return cut(quality.scored(rows, quality.customer_rules(self.config)).drop("is_fake_name"), "golden")


def _clusters(plan: MdmPlan | LatestPlan) -> DataFrame:
    """Clusters need links that connect, or each record's least first end, and not all pairs, unless suppressions take some of these away. Pairs that are there already serve as well."""
    one = plan.config.clustering == "onehop"
    if plan.suppressions is not None or "matches" in plan.__dict__:
        links = plan.matches
    else:
        links = (matching.onehop_stars if one else matching.match_stars)(plan.base, plan.config)
    return (cluster.onehop if one else cluster.transitive)(plan.base, links)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fixture(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The CRM feeds that the driver's customer table gives."""
    records = spark.sql(fixtures.RECORDS.replace(" from customer)", " from {customer})"), customer=read(spark, sf_dir, "customer"))
    return {"records": records} | {name: spark.sql(sql.replace("from records,", "from {records},"), records=records) for name, sql in fixtures.RAW.items()}


_plans: dict[tuple, tuple] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files, so that a plan is not kept when they change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)))


def _kept(spark: SparkSession, sf_dir: str, kind: tuple, make) -> MdmPlan | LatestPlan:
    """The plan of this kind, kept for the application as long as the customer table stays as it is."""
    key = (spark.sparkContext.applicationId, sf_dir, *kind)
    state = _state(spark, f"{sf_dir}/customer.parquet")
    if key not in _plans or _plans[key][0] != state:
        _plans[key] = (state, make())
    return _plans[key][1]


def bulk_plan(spark: SparkSession, sf_dir: str, variant: str = "fuzzy") -> MdmPlan:
    """The bulk plan over the fixture."""

    def make() -> MdmPlan:
        feeds = fixture(spark, sf_dir)
        by = lambda kind: {f"CRM_{s.upper()}": feeds[f"{kind}_{s}"] for s in "abc"}
        return MdmPlan(spark, by("raw"), by("addr"), BULK, variant)

    return _kept(spark, sf_dir, ("bulk", variant), make)


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's records as the event-driven engine stores them."""
    return fixture(spark, sf_dir)["records"].withColumn("first_name", normalize.T.initcap(F.col("first_name"))).withColumn("ts", F.expr("cast(substr(source_key, 2) as bigint) * 37 % 1009"))


def latest_plan(spark: SparkSession, sf_dir: str, clustering: str = "transitive") -> LatestPlan:
    """The event-driven plan over the fixture."""
    return _kept(spark, sf_dir, ("nrt", clustering), lambda: LatestPlan(spark, latest_records(spark, sf_dir), replace(NRT, clustering=clustering)))
