"""Every query of the engine by name, with DuckDB SQL of its own to be held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BULK, NRT
from ..functions import text as T
from ..operators import admin, blocking, cluster, enrich, history, matching, normalize, quality, serving, survivorship
from ..sources import fixtures
from ..sources.readers import append_feed, clear_tokens, feed_schema, read_feed
from ..sources.session import shared_folder
from ..streaming import engine
from ..streaming.state import EventEngine
from . import oracle
from .mdm import bulk_plan, fixture, latest_plan, latest_records, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_CUSTOMER = "customer_id, first_name, last_name, email, phone, dq_score"
_RULES = ", ".join(f"cast({r} as double) {r}" for r in matching.RULES)
_PAIR = "source_a, key_a, source_b, key_b"
_DAY = "strftime({0}, '%Y-%m-%d')"


def query(name: str, sql: str | None = None, variant: str = "fuzzy") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle.sql(sql, variant)
        return f

    return add


def _days(df: DataFrame, *columns: str) -> DataFrame:
    """Times as days in text, which don't depend on a session's time zone."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def both(name: str, sql: str, variant: str = "fuzzy") -> None:
    """A query whose SQL runs alike on Spark, over the plan's tables, and on DuckDB."""
    import re

    tables = [t for t in oracle.tables() if re.search(rf"\b(from|join)\s+{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan, text = bulk_plan(spark, sf_dir, variant), sql
        for t in tables:
            text = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
        feeds = fixture(spark, sf_dir) if any(t in fixtures.RAW or t == "records" for t in tables) else {}
        return spark.sql(text, **{t: feeds[t] if t in feeds else getattr(plan, t) for t in tables})

    query(name, sql, variant)(run)


# sources and functions -------------------------------------------------------------------------------------------------
@query("src_null_tokens", f"select ticket_customer_id, caller_name, {oracle._clean('callback_email', 'c')} callback_email, {oracle._clean('callback_phone', 'c')} callback_phone, _source_file from raw_c")
def src_null_tokens(spark, sf_dir):
    return clear_tokens(fixture(spark, sf_dir)["raw_c"], "CRM_C")


_FEED = f"select ticket_customer_id, caller_name, {oracle._clean('callback_email', 'c')} callback_email, {oracle._clean('callback_phone', 'c')} callback_phone from raw_c"


def _feed(spark, sf_dir, name: str) -> tuple[DataFrame, str]:
    """The rows of a feed, and a new folder for its files."""
    return fixture(spark, sf_dir)["raw_c"].select(*feed_schema("crm_c_customers").names), f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src_feed_files", _FEED)
def src_feed_files(spark, sf_dir):
    """A feed written as CSV files and read by position."""
    rows, path = _feed(spark, sf_dir, "feed")
    rows.write.csv(path, header=True)
    return read_feed(spark, "crm_c_customers", path).drop("_source_file")


@query("src_feed_appended", _FEED)
def src_feed_appended(spark, sf_dir):
    """A feed whose files arrive in two parts; a load takes what is new, and one without new files takes nothing."""
    rows, path = _feed(spark, sf_dir, "feed")
    part = F.pmod(F.xxhash64("ticket_customer_id"), F.lit(2))
    for some in (0, 1, None):
        if some is not None:
            rows.where(part == some).write.mode("append").csv(f"{path}/files", header=True)
        append_feed(read_feed(spark, "crm_c_customers", f"{path}/files", stream=True), f"{path}/table", f"{path}/mark").awaitTermination()
    return spark.read.parquet(f"{path}/table").drop("_source_file")


@query("normalize_union", "select source_system, source_key, first_name, last_name, email, phone, cast(file_date as varchar) file_date from customer_union")
def normalize_union(spark, sf_dir):
    return bulk_plan(spark, sf_dir).customer_union.drop("row_timestamp").withColumn("file_date", F.col("file_date").cast("string"))


@query("name_split", f"select customer_key, name, split_part(name, ' ', 1) first_part, {oracle.last_words('name')} last_part from raw_b")
def name_split(spark, sf_dir):
    return fixture(spark, sf_dir)["raw_b"].select("customer_key", "name", T.first_word(F.col("name")).alias("first_part"), T.other_words(F.col("name")).alias("last_part"))


@query("file_date_parse", f"select _source_file, cast({oracle._FILE} as varchar) file_date, count(*) n from raw_b group by 1, 2")
def file_date_parse(spark, sf_dir):
    return fixture(spark, sf_dir)["raw_b"].groupBy("_source_file", T.file_date(F.col("_source_file")).cast("string").alias("file_date")).agg(F.count(F.lit(1)).alias("n"))


@query("address_union", "select source_system, source_key, source_customer_key, street, city, postal_code, country, cast(file_date as varchar) file_date from address_union")
def address_union(spark, sf_dir):
    return bulk_plan(spark, sf_dir).address_union.drop("row_timestamp").withColumn("file_date", F.col("file_date").cast("string"))


@query("fn_initcap", f"select distinct last_name, {oracle.initcap('last_name')} capital from raw_a")
def fn_initcap(spark, sf_dir):
    return fixture(spark, sf_dir)["raw_a"].select("last_name", T.initcap(F.col("last_name")).alias("capital")).distinct()


@query("fn_soundex", f"select distinct last_name, {oracle.soundex('last_name')} sound from records")
def fn_soundex(spark, sf_dir):
    return fixture(spark, sf_dir)["records"].select("last_name", F.soundex("last_name").alias("sound")).distinct()


_NAMES = "select distinct first_name || ' ' || last_name n, {0} g from records"


@query("fn_jaro_winkler", f"with n as ({_NAMES.format(oracle.soundex('last_name'))}) select a.n a, b.n b, round(jaro_winkler_similarity(a.n, b.n), 6) similarity from n a join n b on a.g = b.g and a.n <= b.n".replace("with n as", "select * from (with n as") + ")")
def fn_jaro_winkler(spark, sf_dir):
    names = fixture(spark, sf_dir)["records"].select(F.concat("first_name", F.lit(" "), "last_name").alias("n"), F.soundex("last_name").alias("g")).distinct()
    pairs = names.alias("x").join(names.alias("y"), F.expr("x.g = y.g and x.n <= y.n")).select(F.col("x.n").alias("a"), F.col("y.n").alias("b"))
    return pairs.withColumn("similarity", F.round(T.jaro_winkler(F.col("a"), F.col("b")), 6))


@query("row_hash", f"select customer_id, {oracle.HASH} row_hash from customers")
def row_hash(spark, sf_dir):
    return bulk_plan(spark, sf_dir).customers.select("customer_id", history.row_hash(history.CUSTOMER).alias("row_hash"))


_ENRICHED = "select source_system, source_key, first_name, last_name, canonical_first_name, is_fake_name, cast(file_date as varchar) file_date from enriched"


def _enriched(variant: str) -> Query:
    return lambda spark, sf_dir: bulk_plan(spark, sf_dir, variant).enriched.selectExpr("source_system", "source_key", "first_name", "last_name", "canonical_first_name", "is_fake_name", "cast(file_date as string) file_date")


query("enrich_fuzzy", _ENRICHED)(_enriched("fuzzy"))
query("enrich_nickname", _ENRICHED, "ai")(_enriched("ai"))


_NAMED = "select c_custkey, case c_custkey % 5 when 0 then 'Test User' when 1 then 'asdf QWERTY' when 2 then 'Chuck Lee' else 'Ann Lee' end full_name from customer"


@query("enrich_fake_name", f"select c_custkey, full_name, c_custkey % 5 < 2 is_fake_name, case c_custkey % 5 when 0 then 'Test' when 1 then 'Asdf' when 2 then 'Charles' else 'Ann' end canonical_first_name from ({_NAMED})")
def enrich_fake_name(spark, sf_dir):
    named = spark.sql(_NAMED.replace(" from customer", " from {customer}"), customer=read(spark, sf_dir, "customer"))
    split = named.withColumn("first_name", T.first_word(F.col("full_name"))).withColumn("last_name", T.other_words(F.col("full_name")))
    return enrich.enrich(split, "ai").select("c_custkey", "full_name", "is_fake_name", "canonical_first_name")


# blocking and matching -------------------------------------------------------------------------------------------------
_BLOCKS = "source_system, source_key, block_soundex, block_email_domain, block_phone_suffix"


@query("blocking_keys", f"select {_BLOCKS} from nrt_base")
def blocking_keys(spark, sf_dir):
    return latest_plan(spark, sf_dir).base.selectExpr(*_BLOCKS.split(", "))


@query("block_stats", " union all ".join(f"select '{k}' block_key, count(*) blocks, coalesce(max(n), 0) largest from (select {k}, count(*) n from nrt_base where {k} is not null group by 1)" for k in blocking.KEYS))
def block_stats(spark, sf_dir):
    return blocking.block_stats(latest_plan(spark, sf_dir).base)


@query("match_base", "select source_system, source_key, first_name, last_name, canonical_first_name, is_fake_name, email, phone, street, city, postal_code, block_soundex, block_email_domain, block_phone_suffix from base")
def match_base(spark, sf_dir):
    return bulk_plan(spark, sf_dir).base


@query("candidate_pairs", f"select {_PAIR} from nrt_pairs")
def candidate_pairs(spark, sf_dir):
    pairs = blocking.candidate_pairs(latest_plan(spark, sf_dir).base, ("source_system", "source_key"))
    return pairs.select(F.col("source_system_a").alias("source_a"), F.col("source_key_a").alias("key_a"), F.col("source_system_b").alias("source_b"), F.col("source_key_b").alias("key_b"))


_TIERS = {"block_email_domain": 0, "block_phone_suffix": 1, "block_soundex": 2}
_TIER_SQL = " union all ".join(
    f"select p.source_system source_system_a, p.source_key source_key_a, c.source_system source_system_b, c.source_key source_key_b, {t} tier, row_number() over (partition by p.source_system, p.source_key order by c.source_system, c.source_key) place from nrt_base p join nrt_base c on p.{k} = c.{k} and (p.source_system, p.source_key) <> (c.source_system, c.source_key) qualify place <= 50"
    for k, t in _TIERS.items()
)
_FOUR = "source_system_a, source_key_a, source_system_b, source_key_b"


@query(
    "candidate_pairs_capped",
    f"select {_FOUR}, cast(r as integer) rank from (select *, row_number() over (partition by source_system_a, source_key_a order by tier, place, source_system_b, source_key_b) r from (select *, sum(case when tier < 2 then 1 else 0 end) over (partition by source_system_a, source_key_a) early from (select {_FOUR}, min(tier) tier, arg_min(place, tier) place from ({_TIER_SQL}) group by all)) where tier < 2 or early < 50) where r <= 100",
)
def candidate_pairs_capped(spark, sf_dir):
    base = latest_plan(spark, sf_dir).base
    return blocking.tiered_candidates(base, base, NRT)


@query("candidate_pairs_block_limit", f"select distinct {_PAIR} from (" + " union all ".join(f"select a.source_system source_a, a.source_key key_a, b.source_system source_b, b.source_key key_b from nrt_base a join nrt_base b on a.{k} = b.{k} and (a.source_system, a.source_key) < (b.source_system, b.source_key) where a.{k} in (select {k} from nrt_base group by 1 having count(*) <= 40)" for k in blocking.KEYS) + ")")
def candidate_pairs_block_limit(spark, sf_dir):
    """The option that leaves out large blocks, with a limit at which it bites here."""
    pairs = blocking.candidate_pairs(latest_plan(spark, sf_dir).base, ("source_system", "source_key"), limit=40)
    return pairs.select(F.col("source_system_a").alias("source_a"), F.col("source_key_a").alias("key_a"), F.col("source_system_b").alias("source_b"), F.col("source_key_b").alias("key_b"))


_SCORED = f"{_PAIR}, {_RULES}, cast(score as double) score"


@query("match_scores", f"select {_SCORED} from nrt_scores")
def match_scores(spark, sf_dir):
    return matching.match_scores(latest_plan(spark, sf_dir).base, NRT).selectExpr(*_SCORED.split(", "))


@query("match_scores_bulk", f"select {_SCORED} from scores")
def match_scores_bulk(spark, sf_dir):
    """All blocked pairs of versions with their addresses."""
    return matching.match_scores(bulk_plan(spark, sf_dir).base, BULK).selectExpr(*_SCORED.split(", "))


@query("match_rule_counts", " union all ".join(f"select '{r}' rule, count(*) pairs from nrt_scores where {r} > 0" for r in matching.RULES))
def match_rule_counts(spark, sf_dir):
    return matching.blocked_rule_counts(latest_plan(spark, sf_dir).base, NRT)


@query("matches", f"select {_PAIR} from nrt_matches")
def matches(spark, sf_dir):
    return latest_plan(spark, sf_dir).matches


@query("matches_bulk", f"select {_PAIR} from matches")
def matches_bulk(spark, sf_dir):
    return bulk_plan(spark, sf_dir).matches


@query("matches_bulk_ai", f"select {_PAIR} from matches", "ai")
def matches_bulk_ai(spark, sf_dir):
    return bulk_plan(spark, sf_dir, "ai").matches


_SUPPRESSED = "cast(substr(key_a, 2) as integer) % 3 = 0"


@query("matches_unsuppressed", f"select {_PAIR} from nrt_matches where not ({_SUPPRESSED})")
def matches_unsuppressed(spark, sf_dir):
    """Suppressions are stored in either order."""
    found = latest_plan(spark, sf_dir).matches
    named = found.where(_SUPPRESSED).selectExpr("source_b source_system_a", "key_b source_key_a", "source_a source_system_b", "key_a source_key_b")
    return matching.unsuppressed(found, named)


# clusters --------------------------------------------------------------------------------------------------------------
_CLUSTER = "source_system, source_key, cluster_id"


@query("clusters_onehop", f"select {_CLUSTER} from nrt_onehop")
def clusters_onehop(spark, sf_dir):
    return latest_plan(spark, sf_dir, "onehop").clusters.selectExpr(*_CLUSTER.split(", "))


@query("clusters_transitive", f"select {_CLUSTER} from nrt_clusters")
def clusters_transitive(spark, sf_dir):
    return latest_plan(spark, sf_dir).clusters.selectExpr(*_CLUSTER.split(", "))


@query("cluster_numbers", f"select customer_id, {_CLUSTER} from nrt_groups")
def cluster_numbers(spark, sf_dir):
    return latest_plan(spark, sf_dir).groups


@query("customer_groups", f"select customer_id, {_CLUSTER} from groups")
def customer_groups(spark, sf_dir):
    return bulk_plan(spark, sf_dir).groups


_HALF = "cast(substr(source_key, 2) as bigint) % 2"


@query("cluster_merge", f"select source_system, source_key, cast(first_value(c) over (partition by g order by n desc, c) as bigint) cluster_id from (select source_system, source_key, customer_id g, customer_id * 2 + {_HALF} c, count(*) over (partition by customer_id, {_HALF}) n from nrt_groups)")
def cluster_merge(spark, sf_dir):
    """Each cluster cut in two halves, then merged again along a chain of links through its records."""
    groups = latest_plan(spark, sf_dir).groups
    halves = groups.selectExpr("source_system", "source_key", f"customer_id * 2 + {_HALF} cluster_id")
    first = groups.groupBy("customer_id").agg(F.min(F.struct("source_system", "source_key")).alias("f"))
    links = groups.join(first, "customer_id").selectExpr("f.source_system source_a", "f.source_key key_a", "source_system source_b", "source_key key_b")
    return cluster.merge_into(halves, links)


@query(
    "unmatch",
    """with big as (select customer_id from nrt_groups group by 1 order by count(*) desc, 1 limit 1), m as (select source_system, source_key from nrt_groups where customer_id in (select customer_id from big)), x as (select * from m order by 1, 2 limit 1)
select least((x.source_system, x.source_key), (m.source_system, m.source_key))[1] source_system_a, least((x.source_system, x.source_key), (m.source_system, m.source_key))[2] source_key_a,
  greatest((x.source_system, x.source_key), (m.source_system, m.source_key))[1] source_system_b, greatest((x.source_system, x.source_key), (m.source_system, m.source_key))[2] source_key_b, 'wrong merge' reason, 'tester' created_by
from x, m where (m.source_system, m.source_key) <> (x.source_system, x.source_key)""".replace("with big as", "select * from (with big as")
    + ")",
)
def unmatch(spark, sf_dir):
    """The suppressions of taking the first record out of the largest cluster."""
    members = latest_plan(spark, sf_dir).groups.selectExpr("source_system", "source_key", "customer_id cluster_id")
    largest = members.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").first()["cluster_id"]
    first = members.where(F.col("cluster_id") == largest).orderBy("source_system", "source_key").first()
    return admin.unmatch(members, largest, [(first["source_system"], first["source_key"])], "wrong merge", "tester", "2024-01-01").suppressions


# survivorship, quality, golden records ---------------------------------------------------------------------------------
@query("survivorship", "select customer_id, cast(file_date as varchar) file_date, first_name, last_name, email, phone, is_fake_name from survived")
def survivorship_(spark, sf_dir):
    plan = bulk_plan(spark, sf_dir)
    return survivorship.golden_bulk(plan.groups, plan.enriched, BULK).selectExpr("customer_id", "cast(file_date as string) file_date", "first_name", "last_name", "email", "phone", "is_fake_name")


@query("source_count", "select customer_id, source_count from counts")
def source_count(spark, sf_dir):
    return survivorship.source_count(bulk_plan(spark, sf_dir).groups)


def _rule_points(mode: str) -> str:
    return ", ".join(f"cast({sql} as integer) {name}" for name, sql in oracle.dq(mode).items())


@query("dq_rules", f"select customer_id, cast(file_date as varchar) file_date, {_rule_points('bulk')} from survived")
def dq_rules(spark, sf_dir):
    rules = quality.customer_rules(BULK)
    return bulk_plan(spark, sf_dir).golden.select("customer_id", F.col("file_date").cast("string").alias("file_date"), *[c.alias(n) for n, c in rules.items()])


@query("dq_rules_nrt", f"select customer_id, {_rule_points('nrt')}, dq_score from nrt_golden")
def dq_rules_nrt(spark, sf_dir):
    rules = {n: c for n, c in quality.customer_rules(NRT).items()}
    return latest_plan(spark, sf_dir).golden.select("customer_id", *[c.alias(n) for n, c in rules.items()], "dq_score")


_GOLDEN = f"{_CUSTOMER}, source_count, cast(file_date as varchar) file_date"


def _golden(variant: str) -> Query:
    return lambda spark, sf_dir: bulk_plan(spark, sf_dir, variant).golden.selectExpr(*_GOLDEN.replace("varchar", "string").split(", "))


query("golden_customer", f"select {_GOLDEN} from golden")(_golden("fuzzy"))
query("golden_customer_ai", f"select {_GOLDEN} from golden", "ai")(_golden("ai"))


@query("golden_customer_nrt", f"select {_CUSTOMER}, source_count, ts from nrt_golden")
def golden_customer_nrt(spark, sf_dir):
    return latest_plan(spark, sf_dir).golden


@query("current_customer", f"select {_CUSTOMER}, source_count, {_DAY.format('last_updated')} last_updated from customers")
def current_customer(spark, sf_dir):
    return _days(bulk_plan(spark, sf_dir).customers, "last_updated")


both("dq_score", "select customer_id, dq_score from customers")
both("dq_tiers", "select case when dq_score >= 90 then 'Excellent' when dq_score >= 70 then 'Good' when dq_score >= 50 then 'Fair' else 'Poor' end dq_tier, count(*) customers, min(dq_score) lowest, max(dq_score) highest from customers group by 1")
both("dq_spot_checks", "select 'disposable' spot, count(*) n from customers where email like '%@mailinator.com' and dq_score < 100 union all select 'placeholder', count(*) from customers where phone = '1111111111' and dq_score <= 85 union all select 'no email', count(*) from customers where email is null and dq_score <= 80")

# history ---------------------------------------------------------------------------------------------------------------
_PERIOD = f"coalesce({_DAY.format('valid_from')}, '') valid_from, coalesce({_DAY.format('valid_to')}, '') valid_to, is_valid, row_hash"


def _periods(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")) for c in ("valid_from", "valid_to")})


@query("history_customer", f"select {_CUSTOMER}, {_PERIOD} from customer_history")
def history_customer(spark, sf_dir):
    return _periods(bulk_plan(spark, sf_dir).customer_history)


@query("history_address", f"select address_id, customer_id, address_type, street, city, postal_code, country, is_primary, dq_score, {_PERIOD} from address_history")
def history_address(spark, sf_dir):
    return _periods(bulk_plan(spark, sf_dir).address_history)


_AT = "2024-02-01"


@query("point_in_time", f"select {_CUSTOMER}, {_PERIOD} from customer_history where valid_from <= timestamp '{_AT}' and valid_to >= timestamp '{_AT}'")
def point_in_time(spark, sf_dir):
    return _periods(history.at_time(bulk_plan(spark, sf_dir).customer_history, _AT))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    golden = bulk_plan(spark, sf_dir).golden
    return tuple(golden.where(F.col("file_date") == d).select("customer_id", *history.CUSTOMER) for d in ("2024-01-01", "2024-02-01"))


def _stored(first: DataFrame) -> DataFrame:
    when = F.lit("2024-01-01").cast("timestamp")
    return first.withColumn("row_hash", history.row_hash(history.CUSTOMER)).withColumns({"valid_from": when, "valid_to": F.lit(history.OPEN).cast("timestamp"), "is_current": F.lit(True)})


_TWO = f"(select customer_id, first_name, last_name, email, phone, dq_score, {oracle.HASH} row_hash from golden where file_date = date '2024-0{{0}}-01')"
_O, _N = _TWO.format(1), _TWO.format(2)


@query(
    "scd2_apply",
    f"select o.*, '2024-01-01' valid_from, case when n.row_hash <> o.row_hash then '2024-02-01' else '9999-12-31' end valid_to, coalesce(n.row_hash = o.row_hash, true) is_current from {_O} o left join {_N} n using (customer_id) union all select n.*, '2024-02-01', '9999-12-31', true from {_N} n left join {_O} o using (customer_id) where o.row_hash is null or o.row_hash <> n.row_hash",
)
def scd2_apply(spark, sf_dir):
    first, second = _snapshots(spark, sf_dir)
    return _days(history.apply_snapshot(_stored(first), second, history.CUSTOMER, F.lit("2024-02-01").cast("timestamp")), "valid_from", "valid_to")


@query("golden_cdc", f"select customer_id, n.row_hash, o.row_hash previous_hash, case when o.row_hash is null then null else '2024-01-01' end previous_valid_from, case when n.row_hash is null then 'CLOSE' when o.row_hash is null then 'INSERT' when o.row_hash = n.row_hash then 'NO_CHANGE' else 'UPDATE' end event_type from {_O} o full join {_N} n using (customer_id)")
def golden_cdc(spark, sf_dir):
    first, second = _snapshots(spark, sf_dir)
    after = second.withColumn("row_hash", history.row_hash(history.CUSTOMER)).withColumn("valid_from", F.lit("2024-02-01").cast("timestamp"))
    return _days(history.changes(_stored(first), after).drop("valid_from"), "previous_valid_from")


@query("xref_cdc", "select t.source_system, t.source_key, t.cluster_id, o.cluster_id previous_cluster_id, case when o.cluster_id is null then 'ASSIGN' else 'REASSIGN' end event_type from nrt_clusters t left join (select c.* from nrt_onehop c join nrt_records r on c.source_system = r.source_system and c.source_key = r.source_key where ts < 900) o on t.source_system = o.source_system and t.source_key = o.source_key where o.cluster_id is null or o.cluster_id <> t.cluster_id")
def xref_cdc(spark, sf_dir):
    """From one-hop clusters of all but the newest records to transitive ones of all."""
    plan = latest_plan(spark, sf_dir)
    known = plan.records.where("ts < 900").select("source_system", "source_key")
    before = latest_plan(spark, sf_dir, "onehop").clusters.join(known, ["source_system", "source_key"], "left_semi")
    return history.reassignments(before, plan.clusters)


# addresses, cross-references, views ------------------------------------------------------------------------------------
@query("address_groups", "select address_id, customer_id, source_system, source_key, cluster_id from address_groups")
def address_groups(spark, sf_dir):
    return bulk_plan(spark, sf_dir).address_groups


_PLACE = "address_id, customer_id, address_type, street, city, postal_code, country, is_primary, dq_score"


@query("address_golden", f"select {_PLACE}, cast(file_date as varchar) file_date from golden_addresses")
def address_golden(spark, sf_dir):
    return bulk_plan(spark, sf_dir).golden_addresses.selectExpr(*_PLACE.split(", "), "cast(file_date as string) file_date")


both("current_address", f"select {_PLACE} from current_addresses")


@query("address_dq_rules", "select customer_id, cast(file_date as varchar) file_date, " + ", ".join(f"cast({c} as integer) {n}" for n, c in oracle.ADDRESS_DQ.items()) + " from golden_addresses")
def address_dq_rules(spark, sf_dir):
    return bulk_plan(spark, sf_dir).golden_addresses.select("customer_id", F.col("file_date").cast("string").alias("file_date"), *[c.alias(n) for n, c in quality.address_rules().items()])


both("customer_xref", "select xref_id, customer_id, source_system, source_key from customer_xref")
both("address_xref", "select xref_id, address_id, source_system, source_key from address_xref")

_TIER = "case when {0} >= 90 then 'Excellent' when {0} >= 70 then 'Good' when {0} >= 50 then 'Fair' else 'Poor' end dq_tier"
_ALL = "string_agg(a.address_id || '/' || coalesce(street, '') || '/' || coalesce(city, '') || '/' || a.dq_score, ';')"


@query(
    "customer_360",
    f"""select c.customer_id, first_name, last_name, first_name || ' ' || last_name full_name, email, phone, c.dq_score, {_TIER.format('c.dq_score')}, source_count, {_DAY.format('last_updated')} last_updated, case when a.address_id is null then 0 else 1 end address_count,
  street primary_street, city primary_city, postal_code primary_postal_code, country primary_country, concat_ws(', ', street, city, postal_code, country) primary_address_full, a.dq_score primary_address_dq_score,
  case when a.address_id is not null then a.address_id || '/' || coalesce(street, '') || '/' || coalesce(city, '') || '/' || a.dq_score end all_addresses from customers c left join current_addresses a on c.customer_id = a.customer_id""",
)
def customer_360(spark, sf_dir):
    view = _days(bulk_plan(spark, sf_dir).customer_360, "last_updated").withColumn("address_count", F.col("address_count").cast("int"))
    line = lambda a: F.concat_ws("/", a["address_id"].cast("string"), F.coalesce(a["street"], F.lit("")), F.coalesce(a["city"], F.lit("")), a["dq_score"].cast("string"))
    return view.withColumn("all_addresses", F.array_join(F.transform("all_addresses", line), ";"))


@query("customer_360_flat", f"select c.customer_id, first_name, last_name, email, phone, c.dq_score, {_TIER.format('c.dq_score')}, source_count, {_DAY.format('last_updated')} last_updated, address_id, address_type, street, city, postal_code, country, is_primary, a.dq_score address_dq_score from customers c left join current_addresses a on c.customer_id = a.customer_id")
def customer_360_flat(spark, sf_dir):
    return _days(bulk_plan(spark, sf_dir).customer_360_flat, "last_updated")


def _has(c: str) -> str:
    return f"coalesce(contains(lower(cast({c} as varchar)), 'hart'), false)"


@query("search_customers", f"select {_CUSTOMER}, {_TIER.format('dq_score')} from customers where ({' or '.join(map(_has, ('first_name', 'last_name', 'email', 'customer_id')))} or customer_id in (select customer_id from current_addresses where {' or '.join(map(_has, ('street', 'city', 'country')))})) and dq_score >= 70")
def search_customers(spark, sf_dir):
    plan = bulk_plan(spark, sf_dir)
    return serving.search(plan.customers, plan.current_addresses, "Hart", ("Excellent", "Good")).selectExpr(*_CUSTOMER.split(", "), "dq_tier")


def _kept(plan) -> DataFrame:
    return plan.customer_history.withColumnRenamed("is_valid", "is_current")


@query("get_customer", f"select {_CUSTOMER}, row_hash from customer_history where customer_id = 10 and is_valid")
def get_customer(spark, sf_dir):
    return serving.get_customer(_kept(bulk_plan(spark, sf_dir)), 10).selectExpr(*_CUSTOMER.split(", "), "row_hash")


@query("get_sources", "select g.customer_id, r.source_system, r.source_key, first_name, last_name, email, phone from nrt_groups g join nrt_records r on g.source_system = r.source_system and g.source_key = r.source_key where customer_id = 10")
def get_sources(spark, sf_dir):
    plan = latest_plan(spark, sf_dir)
    return serving.get_sources(plan.groups, plan.records, 10).select("customer_id", "source_system", "source_key", "first_name", "last_name", "email", "phone")


@query("get_history", f"select {_CUSTOMER}, {_PERIOD.replace('is_valid', 'is_valid is_current')} from customer_history where customer_id = 10")
def get_history(spark, sf_dir):
    return _periods(serving.get_history(_kept(bulk_plan(spark, sf_dir)), 10))


@query("cluster_lookup", "select source_system, source_key, customer_id cluster_id from nrt_groups where source_system = 'CRM_C'")
def cluster_lookup(spark, sf_dir):
    """Clusters of a batch of keys, some of them repeated and one unknown."""
    plan = latest_plan(spark, sf_dir)
    keys = plan.records.where("source_system = 'CRM_C'").select("source_system", "source_key")
    asked = keys.unionByName(keys).unionByName(spark.sql("select 'CRM_C' source_system, 'nobody' source_key"))
    return serving.cluster_ids(plan.groups.selectExpr("source_system", "source_key", "customer_id cluster_id"), asked)


@query("health", "select 'ok' status, count(*) customers from customer_history where is_valid")
def health(spark, sf_dir):
    return serving.health(_kept(bulk_plan(spark, sf_dir)))


@query("audit_reads", """select 'READ' event_type, 'rest:read' actor, customer_id cluster_id, 'READ' action, '{"path":"/customers/' || customer_id || '"}' detail from customers""")
def audit_reads(spark, sf_dir):
    """What the audit tells of a read of all customers."""
    return serving.read_audit(bulk_plan(spark, sf_dir).customers, "/customers", "2024-01-01").select("event_type", "actor", "cluster_id", "action", "detail")


# events ----------------------------------------------------------------------------------------------------------------
def _events(spark, sf_dir) -> DataFrame:
    read(spark, sf_dir, "events").createOrReplaceTempView("goldweave_events")
    return spark.sql(fixtures.EVENTS.replace("from events e", "from goldweave_events e"))


_KEY = "case topic when 'topic.crm.a' then payload->>'$.src_customer_id' when 'topic.crm.b' then payload->>'$.customer_key' else payload->>'$.ticket_customer_id' end"
_GOOD = f"(select case topic when 'topic.crm.a' then 'CRM_A' when 'topic.crm.b' then 'CRM_B' else 'CRM_C' end source_system, {_KEY} source_key, ts, arrival from crm_events where topic <> 'topic.crm.d' and json_valid(payload))"


@query("ingest_quarantine", "select topic, arrival, case when topic = 'topic.crm.d' then 'unknown topic' else 'malformed payload' end reason from crm_events where topic = 'topic.crm.d' or not json_valid(payload)")
def ingest_quarantine(spark, sf_dir):
    return engine.parse(_events(spark, sf_dir))[1].select("topic", "arrival", "reason")


_LATEST = f"select source_system, source_key, ts, arrival from {_GOOD} g qualify row_number() over (partition by source_system, source_key order by ts desc, arrival desc) = 1"


@query("upsert_latest", _LATEST)
def upsert_latest(spark, sf_dir):
    return normalize.latest(engine.parse(_events(spark, sf_dir))[0]).select("source_system", "source_key", "ts", "arrival")


_SKIPPED = f"select source_system, source_key, ts, arrival from (select *, max(ts) over (partition by source_system, source_key order by arrival rows between unbounded preceding and 1 preceding) newest from {_GOOD} g) where ts < newest"


@query("upsert_skipped", _SKIPPED)
def upsert_skipped(spark, sf_dir):
    return normalize.skipped(engine.parse(_events(spark, sf_dir))[0]).select("source_system", "source_key", "ts", "arrival")


@query("stream_ingest", _LATEST)
def stream_ingest(spark, sf_dir):
    """Events as a stream of JSON files through the gate that keeps each key's newest row in state."""
    return engine.run_gate(_events(spark, sf_dir)).select("source_system", "source_key", "ts", "arrival")


def _audit(spark, sf_dir) -> DataFrame:
    good = engine.parse(_events(spark, sf_dir))[0]
    late = normalize.skipped(good).withColumn("cluster_id", F.lit(None).cast("long"))
    return admin.audit_rows(late, "EVENT", F.lit("SKIPPED"), "stream", F.to_json(F.struct("arrival")), F.timestamp_seconds("ts"))


_AUDIT = f"select 'EVENT' event_type, 'stream' actor, source_system, source_key, 'SKIPPED' action, '{{\"arrival\":' || arrival || '}}' detail, ts at_second from ({_SKIPPED})"


@query("audit_log", _AUDIT)
def audit_log(spark, sf_dir):
    return _audit(spark, sf_dir).selectExpr("event_type", "actor", "source_system", "source_key", "action", "detail", "unix_seconds(created_at) at_second")


@query("audit_query", f"select source_system, source_key, max(at_second) at_second from ({_AUDIT}) where source_system = 'CRM_A' group by 1, 2 order by at_second desc, source_key limit 10")
def audit_query(spark, sf_dir):
    newest = _audit(spark, sf_dir).groupBy("source_system", "source_key").agg(F.max("created_at").alias("created_at")).withColumn("event_id", F.col("source_key"))
    return serving.audit_query(newest, 10, source_system="CRM_A").selectExpr("source_system", "source_key", "unix_seconds(created_at) at_second")


# the event engine ------------------------------------------------------------------------------------------------------
_ENGINE = "customer_id, first_name, last_name, email, phone, dq_score, source_count"


def _engine(spark, name: str) -> EventEngine:
    return EventEngine(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


@query("event_engine_golden", f"select {_ENGINE} from ev_golden")
def event_engine_golden(spark, sf_dir):
    """Golden records after all events went through the engine in one batch."""
    state = _engine(spark, "events")
    state.process(_events(spark, sf_dir), 0)
    return state.table("golden").where("is_current").selectExpr(*_ENGINE.split(", "))


@query(
    "event_engine_cdc",
    "select first_name, last_name, email, phone, source_count, (select case when count(*) = 0 then 'INSERT' when bool_or(c.source_system is not null) then 'UPDATE' else 'NO_CHANGE' end from ev_groups g left join ev_groups c on c.customer_id = g.customer_id and c.source_system = 'CRM_C' where g.customer_id = e.customer_id and g.source_system <> 'CRM_C') event_type from ev_golden e",
)
def event_engine_cdc(spark, sf_dir):
    """Change events of a second batch: all events again, after those of two systems alone. What comes again is no change."""
    events, state = _events(spark, sf_dir), _engine(spark, "events")
    state.process(events.where("topic <> 'topic.crm.c'"), 0)
    told = state.process(events, 1).select("customer_id", "event_type")
    golden = state.table("golden").where("is_current").select("customer_id", "first_name", "last_name", "email", "phone", "source_count")
    return told.join(golden, "customer_id").drop("customer_id")


@query("batch_resolve", f"select {_ENGINE} from nrt_golden")
def batch_resolve(spark, sf_dir):
    """Golden records of a first load into the engine's state."""
    state = _engine(spark, "batch")
    state.rebuild(0, latest_records(spark, sf_dir))
    return state.table("golden").where("is_current").selectExpr(*_ENGINE.split(", "))


@query("unmatch_golden", f"with big as (select customer_id from nrt_groups group by 1 order by count(*) desc, 1 limit 1) select customer_id, source_count from nrt_golden where customer_id not in (select customer_id from big) union all select customer_id, cast(count(distinct source_system) as integer) from (select customer_id, source_system from nrt_groups where customer_id in (select customer_id from big) qualify row_number() over (order by source_system, source_key) > 1) group by 1 union all select (select max(customer_id) + 1 from nrt_groups), 1".replace("with big as", "select * from (with big as") + ")")
def unmatch_golden(spark, sf_dir):
    """Current golden records after the first record was taken out of the largest cluster, and a new resolution left it apart."""
    state = _engine(spark, "unmatch")
    state.rebuild(0, latest_records(spark, sf_dir))
    members = state.table("members")
    largest = members.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").first()["cluster_id"]
    first = members.where(F.col("cluster_id") == largest).orderBy("source_system", "source_key").first()
    state.unmatch(1, largest, [(first["source_system"], first["source_key"])], "wrong merge", "tester", "2024-01-01")
    return state.table("golden").where("is_current").select("customer_id", "source_count")


# reports: SQL that runs alike on both engines --------------------------------------------------------------------------
_REPORTS = {
    "report_customers": f"select {_CUSTOMER}, source_count, {_TIER.format('dq_score')} from customers",
    "report_addresses": f"select {_PLACE} from current_addresses",
    "report_xref": "select customer_id, source_system, source_key from customer_xref",
    "report_history": "select customer_id, first_name, last_name, email, phone, dq_score, case when is_valid then 'open' else 'closed' end state from customer_history",
    "report_dq_dist": f"select {_TIER.format('dq_score')}, count(*) customers, cast(round(avg(dq_score), 4) as double) mean_score from customers group by 1",
    "report_er_stats": "select count(*) customers, cast(sum(case when source_count > 1 then 1 else 0 end) as bigint) merged, cast(sum(case when source_count = 3 then 1 else 0 end) as bigint) in_three, cast(round(avg(dq_score), 4) as double) mean_score from customers",
    "report_address_stats": "select count(*) addresses, count(distinct country) countries, count(distinct city) cities, cast(round(avg(dq_score), 4) as double) mean_score from current_addresses",
    "report_country_dist": "select coalesce(country, 'unknown') country, count(*) addresses from current_addresses group by 1",
    "report_source_counts": "select source_system, count(*) n_records, count(distinct source_key) n_keys from customer_union group by 1",
    "report_top20": "select customer_id, first_name, last_name, source_count, dq_score from customers order by source_count desc, dq_score desc, customer_id limit 20",
    "report_dq_hist": "select cast(floor(dq_score / 10) * 10 as integer) bin, count(*) customers from customers group by 1",
    "report_low_dq": f"select {_CUSTOMER} from customers where dq_score < 70",
    "report_addr_completeness": "select count(*) addresses, count(street) with_street, count(city) with_city, count(postal_code) with_postal, count(country) with_country from current_addresses",
    "report_merged": "select customer_id, source_count, dq_score from customers where source_count > 1",
    "report_merge_rate": "select cast(round(100.0 * sum(case when source_count > 1 then 1 else 0 end) / count(*), 2) as double) merged_percent from customers",
    "report_volumes": "select 'crm_a' feed, count(*) n from raw_a union all select 'crm_b', count(*) from raw_b union all select 'crm_c', count(*) from raw_c union all select 'addr_a', count(*) from addr_a union all select 'addr_b', count(*) from addr_b union all select 'addr_c', count(*) from addr_c",
    "report_source_count_dist": "select source_count, count(*) customers, cast(round(100.0 * count(*) / sum(count(*)) over (), 1) as double) percent from customers group by source_count",
    "report_versions": "select customer_id, count(*) versions from customer_history group by 1 having count(*) > 1",
    "report_version_dist": "select versions, count(*) customers from (select customer_id, count(*) versions from customer_history group by 1) v group by versions",
    "report_sample_golden": f"select {_CUSTOMER} from customers order by customer_id limit 10",
    "report_variant_size": "select count(*) customers from customers",
    "report_metrics": "select 'source records' metric, cast(count(*) as double) amount from groups union all select 'golden records', cast(count(*) as double) from customers union all select 'merge percent', cast(round(100.0 * (1 - (select count(*) from customers) * 1.0 / nullif(count(*), 0)), 2) as double) from groups union all select 'mean dq', cast(round(avg(dq_score), 2) as double) from customers",
    "report_completeness": "select cast(round(100.0 * count(email) / count(*), 1) as double) email_percent, cast(round(100.0 * count(phone) / count(*), 1) as double) phone_percent, cast(round(100.0 * count(first_name) / count(*), 1) as double) first_percent, cast(round(100.0 * count(last_name) / count(*), 1) as double) last_percent from customers",
    "engine_stats": "select (select count(*) from customers) current_customers, (select count(*) from groups) source_records, (select count(*) from customer_history) versions, (select count(*) from address_groups) address_links",
    "survivorship_race": "select c.customer_id, g.source_system, g.source_key, e.email candidate, c.email winner, coalesce(e.email = c.email, false) won from customers c join groups g on c.customer_id = g.customer_id join enriched e on g.source_system = e.source_system and g.source_key = e.source_key where c.source_count > 1",
    "survivorship_winners": "select g.source_system, cast(sum(case when e.first_name = c.first_name then 1 else 0 end) as bigint) first_wins, cast(sum(case when e.email = c.email then 1 else 0 end) as bigint) email_wins, cast(sum(case when e.phone = c.phone then 1 else 0 end) as bigint) phone_wins, count(*) n_rows from customers c join groups g on c.customer_id = g.customer_id join enriched e on g.source_system = e.source_system and g.source_key = e.source_key where c.source_count > 1 group by 1",
    "address_winners": "select g.source_system, cast(sum(case when u.street = a.street then 1 else 0 end) as bigint) street_wins, cast(sum(case when u.city = a.city then 1 else 0 end) as bigint) city_wins, count(*) n_rows from current_addresses a join address_groups g on a.customer_id = g.customer_id join address_union u on g.source_system = u.source_system and g.source_key = u.source_key group by 1",
    "lineage": "select c.customer_id, c.first_name golden_first_name, u.source_system, u.source_key, u.first_name source_first_name, cast(u.file_date as varchar(10)) file_date from customers c join groups g on c.customer_id = g.customer_id join customer_union u on g.source_system = u.source_system and g.source_key = u.source_key",
    "report_golden_address": "select c.customer_id, c.last_name, a.street, a.city, a.country from customers c join current_addresses a on c.customer_id = a.customer_id",
}
# invariants: each gives one row with ok
_CHECKS = {
    "check_serving_count": "select a.n = b.n ok from (select count(*) n from customers) a cross join (select count(distinct customer_id) n from groups) b",
    "check_golden_source": "select count(*) = 0 ok from customers c where not exists (select 1 from groups g where g.customer_id = c.customer_id)",
    "check_groups_golden": "select count(*) = 0 ok from groups g where not exists (select 1 from golden c where g.customer_id = c.customer_id)",
    "check_one_current": "select count(*) = 0 ok from (select customer_id from customers group by 1 having count(*) > 1) d",
    "check_one_address": "select count(*) = 0 ok from (select customer_id from current_addresses group by 1 having count(*) > 1) d",
    "check_one_open": "select count(*) = 0 ok from (select customer_id from customer_history where is_valid group by 1 having count(*) <> 1) d",
    "check_dq_bounds": "select count(*) = 0 ok from customers where dq_score < 0 or dq_score > 100",
    "check_address_dq_bounds": "select count(*) = 0 ok from golden_addresses where dq_score < 0 or dq_score > 100",
    "check_history_order": "select count(*) = 0 ok from customer_history where valid_from > valid_to",
    "check_history_overlap": "select count(*) = 0 ok from (select valid_from, lag(valid_to) over (partition by customer_id order by valid_from nulls first) before from customer_history) h where before > valid_from",
    "check_hash_change": "select count(*) = 0 ok from (select row_hash, lag(row_hash) over (partition by customer_id order by valid_from nulls first) before from customer_history) h where before = row_hash",
    "check_xref_unique": "select count(*) = count(distinct xref_id) and min(xref_id) = 1 and max(xref_id) = count(*) ok from customer_xref",
    "check_source_count": "select count(*) = 0 ok from customers where source_count < 1 or source_count > 3",
    "check_id_dense": "select max(customer_id) = count(distinct customer_id) ok from groups",
    "check_address_owner": "select count(*) = 0 ok from current_addresses a where not exists (select 1 from customers c where c.customer_id = a.customer_id)",
    "check_every_record": "select (select count(*) from groups) = (select count(*) from (select distinct source_system, source_key from customer_union) u) ok",
    "check_match_order": "select count(*) = 0 ok from matches where source_a > source_b or (source_a = source_b and key_a >= key_b)",
}
for _name, _sql in (_REPORTS | _CHECKS).items():
    both(_name, _sql)


@query("report_variant_compare")
def report_variant_compare(spark, sf_dir):
    """Both variants side by side."""
    sides = [bulk_plan(spark, sf_dir, v).customers.agg(F.lit(v).alias("variant"), F.count(F.lit(1)).alias("customers"), F.sum((F.col("source_count") > 1).cast("long")).alias("merged"), F.round(F.avg("dq_score"), 4).alias("mean_score")) for v in ("fuzzy", "ai")]
    return reduce(DataFrame.unionByName, sides)


_COMPARE = "select '{0}' variant, count(*) customers, cast(sum(case when source_count > 1 then 1 else 0 end) as bigint) merged, round(avg(dq_score), 4) mean_score from customers"
ORACLES["report_variant_compare"] = f"select * from ({oracle.sql(_COMPARE.format('fuzzy'))}) union all select * from ({oracle.sql(_COMPARE.format('ai'), 'ai')})"
