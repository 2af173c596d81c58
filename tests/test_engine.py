"""Matching, clusters, survivorship, history, splits, feeds and streams on small cases."""

import json
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from goldweave.config import BULK, NRT
from goldweave.operators import admin, blocking, cluster, history, matching, normalize, serving, survivorship
from goldweave.operators.components import connected_components
from goldweave.operators.ids import numbered
from goldweave.sources import readers
from goldweave.sources.session import cut, ship
from goldweave.streaming.engine import parse, run_gate
from goldweave.streaming.state import EventEngine

PERSON = "source_system string, source_key string, first_name string, last_name string, email string, phone string"


def people(spark, *rows):
    ship(spark)
    frame = spark.createDataFrame([(f"CRM_{r[0][0]}", r[0], *r[1:]) for r in rows], PERSON)
    return frame.withColumn("canonical_first_name", F.col("first_name")).withColumn("is_fake_name", F.lit(False))


def score(spark, a, b, config=NRT):
    base = blocking.match_base(people(spark, ("A1", *a), ("B1", *b)))
    pairs = base.alias("a").join(base.alias("b"), F.expr("a.source_key < b.source_key")).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in matching.FIELDS])
    return matching.score_pairs(pairs, config).first()


@pytest.mark.parametrize(
    "a, b, rule, least",
    [
        (("Bill", "Gates", "x@y.com", None), ("Ann", "Lee", "x@y.com", None), "email_match", 1.0),
        (("Bill", "Gates", None, "+11043321819"), ("Ann", "Lee", None, "1043321819"), "phone_match", 0.95),
        (("Ann", "Lee", None, None), ("ANN", "LEE", None, None), "canonical_exact_match", 0.80),
        (("Ann", "Smith", None, None), ("Bob", "Smyth", None, None), "soundex_match", 0.20),
        (("Robert", "Lee", "a@acme.com", None), ("Robert", "Kim", "b@acme.com", None), "email_domain_name_match", 0.15),
        (("Jonathan", "Smithers", None, None), ("Jonathon", "Smithers", None, None), "name_similarity", 0.25),
    ],
)
def test_rules_fire(spark, a, b, rule, least):
    found = score(spark, a, b)
    assert found[rule] >= Decimal(str(least)) and found.score >= found[rule]


@pytest.mark.parametrize("a, b", [((None,) * 4, (None,) * 4), (("Ann", "Lee", "a@b.c", "123"), ("Bob", "Kim", "x@y.z", "456"))])
def test_unrelated_people_do_not_match(spark, a, b):
    assert score(spark, a, b).score < Decimal("0.70")


def test_plus_counts_as_a_character_in_bulk_mode_only(spark):
    pair = ((None, None, None, "+104332181"), (None, None, None, "+104332181"))
    assert score(spark, *pair, BULK).phone_match > 0 and score(spark, *pair).phone_match == 0


def crowd(spark):
    rows = [(f"{'ABC'[i % 3]}{i}", ["Ann", "Anne", "Bob"][i % 3], ["Lee", "Leigh", "Smith"][i % 4 % 3], f"m{i % 7}@d{i % 2}.com", f"+1555000{i % 5:04d}") for i in range(45)]
    return people(spark, *rows)


def places(spark, n=45):
    return spark.createDataFrame([(f"CRM_{'ABC'[i % 3]}", f"{'ABC'[i % 3]}{i}", f"{i % 4} Main Street", "Port", f"{i % 6}") for i in range(n)], "source_system string, source_customer_key string, street string, city string, postal_code string")


@pytest.mark.parametrize("mode", ["bulk", "nrt"])
def test_pruned_matches_equal_scored_ones(spark, mode):
    config = replace(BULK if mode == "bulk" else NRT)
    base = cut(blocking.match_base(crowd(spark), places(spark) if mode == "bulk" else None), "base")
    want = {tuple(r) for r in matching.match_scores(base, config).where("score >= 0.7").select(*matching.IDS).collect()}
    assert {tuple(r) for r in matching.matches(base, config).collect()} == want and want
    low = replace(config, threshold=Decimal("0.35"))
    assert not low.prunable
    assert {tuple(r) for r in matching.matches(base, low).collect()} == {tuple(r) for r in matching.match_scores(base, low).where("score >= 0.35").select(*matching.IDS).collect()}
    touched = spark.createDataFrame([("CRM_A", "A0"), ("CRM_B", "B4")], "source_system string, source_key string")
    assert {tuple(r) for r in matching.matches(base, config, touched).collect()} == {m for m in want if {"A0", "B4"} & set(m)}


def odd_crowd(spark):
    rows = [("A90", None, "Lee", "none", "123"), ("B91", "", "", "", ""), ("C92", "Ann", None, None, "+15550000001"), ("A93", "ann", "LEE", "m1@d0.com", None), ("B94", "Ann", "Lee", "m1@d0.com@x", "5550000002")]
    return crowd(spark).unionByName(people(spark, *rows)).unionByName(crowd(spark).limit(9).withColumn("email", F.lit("other@d0.com")))


def plain_scores(base, config):
    """Each pair of rows that shares a block, scored one by one."""
    base = base.select(*matching.FIELDS).distinct()
    pairs = base.alias("a").join(base.alias("b"), F.expr("(a.source_system, a.source_key) < (b.source_system, b.source_key)")).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in matching.FIELDS])
    return sorted(map(str, matching.score_pairs(pairs.where(blocking.blocked()), config).collect()))


@pytest.mark.parametrize("looked_up", [True, False])
def test_scores_from_cells_are_all_and_never_shuffled(spark, monkeypatch, looked_up):
    base = cut(blocking.match_base(odd_crowd(spark)), "base")
    monkeypatch.setattr(blocking, "CELL", 7)
    monkeypatch.setattr(matching, "SIMILAR", 2_000_000 if looked_up else 0)
    found = matching.match_scores(base, NRT)
    assert sorted(map(str, found.collect())) == plain_scores(base, NRT)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_rule_counts_sum_pairs_that_are_never_shuffled(spark, monkeypatch):
    base = cut(blocking.match_base(odd_crowd(spark)), "base")
    monkeypatch.setattr(blocking, "CELL", 7)
    scores = matching.match_scores(base, NRT)
    counts, rows = matching.rule_counts(scores), scores.collect()
    assert {r.rule: r.pairs for r in counts.collect()} == {rule: sum(r[rule] > 0 for r in rows) for rule in matching.RULES}
    assert counts._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].count("Aggregate") == 1


@pytest.mark.parametrize("names, floor, oneway", [(0, 0.85, False), (2, 0.6, False), (1000, 0.85, False), (2, 0.6, True)])
def test_rule_counts_from_groups_equal_those_of_pairs(spark, monkeypatch, names, floor, oneway):
    """oneway: some names are similar in one order only."""
    monkeypatch.setattr(matching, "NAMES", names)
    if oneway:
        similar = matching._similar

        def some(*args):
            values, found = similar(*args)
            return values, found.where("not (shiftright(ij, 32) > (ij & 4294967295) and ij % 3 = 0)")

        monkeypatch.setattr(matching, "_similar", some)
    rows = [(f"B{300 + i}", first, last, f"m{i % 4}@d{i % 3}.com", f"+1555000{i % 5:04d}") for i, (first, last) in enumerate((x, y) for x in ("abcab", "bacba", "cabbaa", "Anna") for y in ("abbca", "cabac", "Lee"))]
    base = cut(blocking.match_base(odd_crowd(spark).unionByName(people(spark, *rows)).unionByName(people(spark, *rows).withColumn("phone", F.lit("5550000002")))), "base")
    config = replace(NRT, name_floor=floor, first_floor=floor)
    found = matching.blocked_rule_counts(base, config)
    want = {r.rule: r.pairs for r in matching.rule_counts(matching.match_scores(base, config)).collect()}
    assert {r.rule: r.pairs for r in found.collect()} == want and sum(n > 0 for n in want.values()) == 6


def test_rule_counts_make_no_pairs(spark):
    rows = [(f"A{i}", "Ann", "Lee", f"m{i}@d.com", f"+1555{i:07d}") for i in range(3000)]
    joins = []
    base = cut(blocking.match_base(people(spark, *rows)), "base")
    found = matching.blocked_rule_counts(base, NRT)
    pairs = 3000 * 2999 // 2
    assert {r.rule: r.pairs for r in found.collect()} == {r: 0 for r in matching.RULES} | {r: pairs for r in ("canonical_exact_match", "name_similarity", "soundex_match", "email_domain_name_match")}
    plans = [found._jdf.queryExecution().executedPlan()]
    while plans:
        node = plans.pop()
        plans += [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.getClass().getSimpleName():
            joins.append(node.metrics().apply("numOutputRows").value())
    assert joins and max(joins) <= 3 * 7 * len(rows)


@pytest.mark.parametrize("looked_up", [True, False])
def test_bulk_scores_take_streets_from_pairs_of_a_postal_code(spark, monkeypatch, looked_up):
    base = cut(blocking.match_base(odd_crowd(spark), places(spark).unionByName(places(spark, 9).withColumn("street", F.lit("9 Other Road")).withColumn("postal_code", F.lit(None).cast("string")))), "base")
    monkeypatch.setattr(blocking, "CELL", 7)
    monkeypatch.setattr(matching, "SIMILAR", 2_000_000 if looked_up else 0)
    found = matching.match_scores(base, BULK)
    rows = found.collect()
    assert sorted(map(str, rows)) == plain_scores(base, BULK) and any(r.address_similarity for r in rows)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


@pytest.mark.parametrize("mode", ["bulk", "nrt"])
@pytest.mark.parametrize("systems", ["apart", "one begins another"])
def test_stars_cluster_as_matches_do(spark, mode, systems):
    config = BULK if mode == "bulk" else NRT
    rows = [("A90", "Zoe", "Orr", "none", None), ("B91", "Zed", "Orr", "none", None), ("C92", "Zac", "Urr", "none", None), ("A93", None, None, None, None)]
    many = crowd(spark).unionByName(people(spark, *rows)).unionByName(people(spark, *[(f"B{200 + i}", f"N{i}", f"Own{chr(97 + i)}", f"n{i}@own{i}.org", "+15550000001") for i in range(12)]))
    base = cut(blocking.match_base(many, places(spark) if mode == "bulk" else None), "base")
    if systems != "apart":
        base = cut(base.withColumn("source_system", F.replace("source_system", F.lit("CRM_C"), F.lit("CRM_A2"))).withColumn("source_system", F.replace("source_system", F.lit("CRM_B"), F.lit("CRM"))), "base")
    label = lambda f, found: {(r.source_key, r.cluster_id) for r in f(base, found).collect()}
    found = cut(matching.matches(base, config), "found")
    assert label(cluster.transitive, matching.match_stars(base, config)) == label(cluster.transitive, found)
    assert label(cluster.onehop, matching.onehop_stars(base, config)) == label(cluster.onehop, found)


@pytest.mark.parametrize("mode", ["bulk", "nrt"])
def test_stars_of_a_shared_number_are_linear(spark, mode):
    rows = [(f"A{i}", f"N{i}", "".join(chr(97 + int(d)) for d in f"{i:04d}"), None, "+15550000001") for i in range(3000)]
    base = blocking.match_base(people(spark, *rows))
    assert matching.match_stars(base, BULK if mode == "bulk" else NRT).count() == 2999


def test_tiered_candidates_against_loops(spark):
    config = replace(NRT, candidate_limit=3, candidate_cap=5)
    base = cut(blocking.match_base(crowd(spark).unionByName(crowd(spark).limit(9).withColumn("email", F.lit("other@d0.com")))), "base")
    rows = base.collect()
    want = set()
    for me in {(r.source_system, r.source_key) for r in rows}:
        first = {}
        for tier, key in enumerate(("block_email_domain", "block_phone_suffix", "block_soundex")):
            mine = {r[key] for r in rows if (r.source_system, r.source_key) == me and r[key] is not None}
            others = sorted({(r.source_system, r.source_key) for r in rows if r[key] in mine} - {me})[:3]
            for place, other in enumerate(others):
                first.setdefault(other, (tier, place))
        early = sum(tier < 2 for tier, _ in first.values())
        kept = sorted((tier, place, other) for other, (tier, place) in first.items() if tier < 2 or early < 3)
        want |= {(*me, *other, rank) for rank, (_, _, other) in enumerate(kept[:5], 1)}
    assert {tuple(r) for r in blocking.tiered_candidates(base, base, config).collect()} == want and want


def links(spark, *pairs):
    return spark.createDataFrame([(f"CRM_{a[0]}", a, f"CRM_{b[0]}", b) for a, b in pairs], "source_a string, key_a string, source_b string, key_b string")


def test_onehop_is_not_transitive(spark):
    records = people(spark, *[(k, None, None, None, None) for k in ("A1", "B1", "C1", "C2")])
    found = links(spark, ("A1", "B1"), ("B1", "C1"))
    label = lambda f: {r.source_key: r.cluster_id for r in f(records, found).collect()}
    assert label(cluster.onehop) == {"A1": "CRM_A|A1", "B1": "CRM_A|A1", "C1": "CRM_B|B1", "C2": "CRM_C|C2"}
    assert label(cluster.transitive) == {"A1": "CRM_A|A1", "B1": "CRM_A|A1", "C1": "CRM_A|A1", "C2": "CRM_C|C2"}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components_against_union_find(spark, shape):
    import random

    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 30)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "none": []}[shape]
    label = {i: i for e in edges for i in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges or [(1, 1)], "a long, b long")
    assert {r.node: r.component for r in connected_components(frame, cut).collect()} == {i: find(i) for i in label if any(i in e and e[0] != e[1] for e in edges)}


def test_numbers_are_dense(spark):
    frame = spark.range(500).selectExpr("cast(id * 7919 % 1009 as string) k")
    rows = sorted((r.k, r.n) for r in numbered(frame, ["k"], "n").collect())
    assert [n for _, n in rows] == list(range(1, 501))


def test_merge_takes_the_larger_and_then_the_smaller_id(spark):
    members = spark.createDataFrame([("CRM_A", "A1", 5), ("CRM_A", "A2", 9), ("CRM_A", "A3", 9), ("CRM_B", "B1", 7), ("CRM_B", "B2", 8)], "source_system string, source_key string, cluster_id long")
    after = cluster.merge_into(members, links(spark, ("A1", "A2"), ("B1", "B2")))
    assert {r.source_key: r.cluster_id for r in after.collect()} == {"A1": 9, "A2": 9, "A3": 9, "B1": 7, "B2": 7}


def golden(spark, *rows):
    frame = spark.createDataFrame([(f"CRM_{r[0]}", f"{r[0]}{i}", *r[1:]) for i, r in enumerate(rows)], f"{PERSON}, ts long")
    groups = frame.select(F.lit(1).cast("long").alias("customer_id"), "source_system", "source_key")
    return survivorship.golden_latest(groups, frame, NRT).first()


def test_survivorship(spark):
    assert golden(spark, ("A", None, None, None, None, 1), ("B", "Bob", "Lee", "b@c.d", "5551234567", 1))[1:5] == ("Bob", "Lee", "b@c.d", "5551234567")
    assert golden(spark, ("B", "Bob", "Lee", "b@c", "5551234", 9), ("A", "Ann", "Kim", "a@c", "7771234", 1)).first_name == "Ann"
    assert golden(spark, ("A", "A", "Lee", "bad", "123", 9), ("C", "Cy", "Lee", "c@d", "5551234567", 1))[1:5] == ("Cy", "Lee", "c@d", "5551234567")
    assert golden(spark, ("A", "A", None, "bad", "1", 1), ("B", "B", "", "worse", "2", 9))[1:5] == ("B", None, "worse", "2")
    assert golden(spark, ("A", None, None, None, None, 1))[1:5] == (None,) * 4


def test_history_periods_do_not_overlap(spark):
    rows = [(1, "2024-01-01", "a"), (1, "2024-02-01", "a"), (1, "2024-03-01", "b"), (1, "2024-04-01", "a"), (2, "2024-01-01", None)]
    versions = spark.createDataFrame(rows, "customer_id long, d string, email string").selectExpr("customer_id", "cast(d as date) file_date", "cast(d as timestamp) row_timestamp", "email")
    found = history.history(versions, "customer_id", ("email",)).orderBy("customer_id", "valid_from")
    got = [(r.customer_id, str(r.valid_from)[:10], str(r.valid_to)[:10], r.is_valid) for r in found.collect()]
    assert got == [(1, "2024-01-01", "2024-03-01", False), (1, "2024-03-01", "2024-04-01", False), (1, "2024-04-01", "9999-12-31", True), (2, "2024-01-01", "9999-12-31", True)]
    assert history.at_time(found, "2024-03-01").where("customer_id = 1").count() == 2 and history.at_time(found, "2024-03-01", closed=False).where("customer_id = 1").count() == 1


def test_unmatch(spark):
    members = spark.createDataFrame([("CRM_A", "A1", 4), ("CRM_B", "B1", 4), ("CRM_C", "C1", 4), ("CRM_C", "C2", 6)], "source_system string, source_key string, cluster_id long")
    split = admin.unmatch(members, 4, [("CRM_B", "B1")], "why", "me", "2024-01-01")
    assert split.new_cluster_id == 7 and {r.source_key: r.cluster_id for r in split.members.collect()} == {"A1": 4, "B1": 7, "C1": 4, "C2": 6}
    assert {(r.source_key_a, r.source_key_b) for r in split.suppressions.collect()} == {("A1", "B1"), ("B1", "C1")}
    audit = split.audit.first()
    assert (audit.event_type, audit.action, audit.source_key) == ("ADMIN", "UNMATCH", "B1")
    assert matching.unsuppressed(links(spark, ("A1", "B1"), ("A1", "C1")), split.suppressions).collect()[0].key_b == "C1"
    for cluster_id, records in ((99, [("CRM_A", "A1")]), (4, [("CRM_C", "C2")]), (4, [("CRM_A", "A1"), ("CRM_B", "B1"), ("CRM_C", "C1")])):
        with pytest.raises(admin.UnmatchError):
            admin.unmatch(members, cluster_id, records, "", "", "2024-01-01")


def test_upserts_keep_the_newest(spark):
    rows = [("s", "k", 5, 1), ("s", "k", 3, 2), ("s", "k", 5, 3), ("s", "j", 1, 4)]
    frame = spark.createDataFrame(rows, "source_system string, source_key string, ts long, arrival long")
    assert {(r.source_key, r.arrival) for r in normalize.latest(frame).collect()} == {("k", 3), ("j", 4)}
    assert [r.arrival for r in normalize.skipped(frame).collect()] == [2]


def test_feed_reader(spark, tmp_path):
    (tmp_path / "2024-01-01_crm_c_customers.csv").write_text('id,n,e,p\nC1,"Lee, Ann",N/A,null\nC2,Bob,x@y.z,1\nC3,too,many,fields,here\n')
    rows = readers.read_feed(spark, "crm_c_customers", str(tmp_path)).orderBy("ticket_customer_id").collect()
    assert [tuple(r) for r in rows] == [("C1", "Lee, Ann", None, None, "2024-01-01_crm_c_customers.csv"), ("C2", "Bob", "x@y.z", "1", "2024-01-01_crm_c_customers.csv")]


def test_feed_files_are_loaded_once(spark, tmp_path):
    feed, out, mark = (str(tmp_path / n) for n in ("feed", "table", "mark"))
    (tmp_path / "feed").mkdir()
    for day, count in (("2024-01-01", 1), ("2024-01-02", 2), (None, 2)):
        if day:
            (tmp_path / "feed" / f"{day}_crm_b_customers.csv").write_text(f"k,n,e,m\nB{day[-1]},Ann Lee,a@b.c,1\n")
        readers.append_feed(readers.read_feed(spark, "crm_b_customers", feed, stream=True), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == count


def event(source, key, ts, arrival, **fields):
    names = readers.TOPICS[f"topic.crm.{source}"][1]
    return (f"topic.crm.{source}", key, ts, arrival, json.dumps({names[0]: key} | fields))


EVENTS = "topic string, key string, ts long, arrival long, payload string"


def test_quarantine(spark):
    rows = [event("a", "A1", 1, 1, first_name="x", extra=1), ("topic.crm.z", "Z", 1, 2, "{}"), ("topic.crm.a", "A", 1, 3, "{broken"), ("topic.crm.b", "B", 1, 4, '{"name":"no key"}'), (None, "N", 1, 5, None)]
    good, bad = parse(spark.createDataFrame(rows, EVENTS))
    assert [r.source_key for r in good.collect()] == ["A1"]
    assert {r.arrival: r.reason for r in bad.collect()} == {2: "unknown topic", 3: "malformed payload", 4: "no key", 5: "unknown topic"}


def test_gate_in_a_stream(spark):
    rows = [event("a", "A1", 5, 1), event("a", "A1", 3, 2), event("a", "A1", 7, 3), event("c", "C1", 1, 4)]
    found = run_gate(spark.createDataFrame(rows, EVENTS)).collect()
    assert {(r.source_key, r.ts) for r in found} == {("A1", 7), ("C1", 1)}


def test_event_engine(spark, tmp_path):
    ship(spark)
    engine = EventEngine(spark, str(tmp_path / "state"))
    run = lambda batch, *rows: {r.event_type for r in engine.process(spark.createDataFrame(rows, EVENTS), batch).collect()}
    john = dict(first_name="john", last_name="smith", email="john@x.com", phone="+14155551234")
    assert run(0, event("a", "A1", 10, 1, **john), event("b", "B9", 10, 2, name="Ann Lee", email_address="ann@y.com", mobile="+442071234567")) == {"INSERT"}
    assert run(1, event("a", "A1", 11, 3, **john)) == {"NO_CHANGE"}
    assert run(2, event("a", "A1", 12, 4, **(john | {"last_name": "smythe"}))) == {"UPDATE"}
    run(3, event("a", "A1", 5, 5, **(john | {"last_name": "old"})))  # too late
    assert [r.action for r in engine.table("audit").collect()] == ["SKIPPED"]
    assert run(4, event("b", "B1", 13, 6, name="John Smythe", email_address="JOHN@x.com", mobile="1")) == {"UPDATE"}
    current = engine.table("golden").where("is_current")
    assert sorted((r.first_name, r.source_count) for r in current.collect()) == [("Ann", 1), ("John", 2)]
    assert run(5, event("c", "C1", 14, 7, caller_name="Ann Smythe", callback_email="ann@y.com", callback_phone="+14155551234")) <= {"UPDATE", "CLOSE", "INSERT"}
    rows = engine.table("golden").collect()
    assert sum(r.is_current for r in rows) == 1 and len({r.cluster_id for r in engine.table("members").collect()}) == 1
    assert {"MERGE"} <= {r.action for r in engine.table("audit").collect()}
    periods = sorted((r.customer_id, r.valid_from, r.valid_to) for r in rows)
    assert all(a[2] <= b[1] for a, b in zip(periods, periods[1:], strict=False) if a[0] == b[0])
    before = engine.table("cdc", 5).count()
    assert engine.process(spark.createDataFrame([event("a", "A1", 99, 9)], EVENTS), 5).count() == before and engine.finished() == [0, 1, 2, 3, 4, 5]
    assert serving.get_customer(engine.table("golden"), rows[0].customer_id).count() <= 1


def test_event_engine_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame([event("a", "A1", 1, 1, first_name="ann", last_name="lee", email="a@b.cd", phone=None), event("c", "C1", 2, 2, caller_name="Ann Lee")], EVENTS)
    events.write.json(str(tmp_path / "events"))
    engine = EventEngine(spark, str(tmp_path / "state"))
    engine.start(readers.read_events(spark, str(tmp_path / "events")), str(tmp_path / "mark")).awaitTermination()
    assert [r.source_count for r in engine.table("golden").where("is_current").collect()] == [2]


RECORDS = "source_system string, source_key string, first_name string, last_name string, email string, phone string, ts long"


def test_rebuild_and_unmatch_on_the_state(spark, tmp_path):
    ship(spark)
    rows = [("CRM_A", "A1", "Ann", "Lee", "a@b.cd", "4155551234", 5), ("CRM_B", "B1", "Ann", "Lee", "a@b.cd", None, 6), ("CRM_C", "C1", "Bob", "Ray", "r@b.cd", None, 7)]
    records = spark.createDataFrame(rows, RECORDS)
    engine = EventEngine(spark, str(tmp_path / "state"))
    current = lambda: {(r.customer_id, r.source_count) for r in engine.table("golden").where("is_current").collect()}
    assert {r.event_type for r in engine.rebuild(0, records).collect()} == {"INSERT"} and current() == {(1, 2), (2, 1)}
    assert "TRUNCATE_AND_REBUILD" in {r.action for r in engine.table("audit").collect()}
    assert {r.event_type for r in engine.rebuild(1).collect()} == {"NO_CHANGE"} and engine.table("golden").count() == 2
    kinds = {r.customer_id: r.event_type for r in engine.unmatch(2, 1, [("CRM_B", "B1")], "no", "me", "2024-01-01").collect()}
    assert kinds == {1: "UPDATE", 3: "INSERT"} and current() == {(1, 1), (2, 1), (3, 1)}
    assert {(r.source_key_a, r.source_key_b) for r in engine.table("suppressions").collect()} == {("A1", "B1")}
    assert {r.action for r in engine.table("audit").collect()} >= {"UNMATCH"}
    assert [(r.source_key, r.previous_cluster_id) for r in engine.table("xref").collect()] == [("B1", 1)]
    again = engine.process(spark.createDataFrame([event("b", "B1", 20, 9, name="Ann Lee", email_address="a@b.cd"), ("topic.crm.a", "A9", 21, 10, "{broken")], EVENTS), 3)
    assert current() == {(1, 1), (2, 1), (3, 1)} and again.count() == 1  # they stay apart
    assert [(r.source_key, r.action) for r in engine.table("audit").where("action = 'ERROR'").collect()] == [("A9", "ERROR")]
    engine.rebuild(4)
    assert sorted(n for _, n in current()) == [1, 1, 1] and engine.table("golden").where("is_current").count() == 3
    assert serving.cluster_ids(engine.table("members"), records.where("source_key = 'C1'")).count() == 1
    assert serving.health(engine.table("golden")).first().asDict() == {"status": "ok", "customers": 3}
    told = serving.read_audit(serving.get_customer(engine.table("golden"), 1), "/api/v1/customers", "2024-01-01").collect()
    assert [(r.action, r.cluster_id) for r in told] == [("READ", 1)]


def test_change_events_are_published(spark, tmp_path):
    from goldweave.sources import sinks

    engine = EventEngine(spark, str(tmp_path / "state"))
    cdc = engine.process(spark.createDataFrame([event("a", "A1", 10, 1, first_name="ann", last_name="lee", email="a@b.cd")], EVENTS), 0)
    messages = sinks.golden_messages(cdc, engine.table("golden"), "2024-01-01T00:00:00Z").unionByName(sinks.xref_messages(engine.table("xref"), "2024-01-01T00:00:00Z"))
    sinks.publish(messages, str(tmp_path / "out"))
    rows = {r.topic: (r.key, json.loads(r.value)) for r in spark.read.json(str(tmp_path / "out")).collect()}
    key, golden = rows[sinks.GOLDEN_TOPIC]
    assert key == "1" and golden["event_type"] == "INSERT" and golden["first_name"] == "Ann" and golden["previous_hash"] is None and golden["phone"] is None
    key, xref = rows[sinks.XREF_TOPIC]
    assert key == "CRM_A|A1" and xref["event_type"] == "ASSIGN" and xref["customer_id"] == 1


def test_producer(spark):
    from goldweave.sources import producer

    events = producer.random_events(spark, 300, seed=4)
    good, bad = parse(events)
    assert bad.count() == 0 and {r.source_system for r in good.select("source_system").distinct().collect()} == {"CRM_A", "CRM_B", "CRM_C"}
    assert events.collect() == producer.random_events(spark, 300, seed=4).collect() and good.where("first_name is null or email is null").count() == 0
    feed = spark.createDataFrame([("B1", "Ann Lee", "a@b.c", "1", "f.csv")], "customer_key string, name string, email_address string, mobile string, _source_file string")
    assert parse(producer.replay({"crm_b_customers": feed}))[0].first().last_name == "Lee"


def test_plans_follow_their_files(spark, tmp_path):
    from goldweave.plans import mdm

    folder = str(tmp_path)
    write = lambda n: spark.range(1, n).selectExpr("int(id) c_custkey", "0 c_nationkey").write.mode("overwrite").parquet(f"{folder}/customer.parquet")
    write(5)
    first = mdm.latest_plan(spark, folder)
    assert mdm.latest_plan(spark, folder) is first
    write(9)
    assert mdm.latest_plan(spark, folder) is not first
