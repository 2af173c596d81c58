"""Blocking keys and candidate pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MdmConfig
from ..functions import text as T

KEYS = ("block_soundex", "block_email_domain", "block_phone_suffix")
_ORDER = ("block_email_domain", "block_phone_suffix", "block_soundex")
#: Members of a block that are held against as many others in one cell, and comparisons that a partition of cells has on average.
CELL, PART = 8192, 4_000_000


def with_blocks(records: DataFrame) -> DataFrame:
    """records with their three blocking keys."""
    return records.withColumns({"block_soundex": F.soundex("last_name"), "block_email_domain": T.domain(F.col("email")), "block_phone_suffix": T.phone_suffix(F.col("phone"))})


def match_base(customers: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Distinct versions of each record with each of its addresses' versions, and blocking keys."""
    columns = ["source_system", "source_key", "first_name", "last_name", "canonical_first_name", "is_fake_name", "email", "phone"]
    base = customers.select(*columns)
    if addresses is None:
        base = base.withColumns({c: F.lit(None).cast("string") for c in ("street", "city", "postal_code")})
    else:
        places = addresses.select("source_system", F.col("source_customer_key").alias("source_key"), "street", "city", "postal_code")
        base = base.join(places, ["source_system", "source_key"], "left")
    return with_blocks(base.distinct())


def block_stats(base: DataFrame) -> DataFrame:
    """Number of blocks and the largest, by key."""
    sides = [base.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("value")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).select(F.lit(k).alias("block_key"), "blocks", "largest") for k in KEYS]
    return reduce(DataFrame.unionByName, sides)


def ends(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    return F.struct(F.col(f"{a}.source_system"), F.col(f"{a}.source_key")), F.struct(F.col(f"{b}.source_system"), F.col(f"{b}.source_key"))


def pair_up(base: DataFrame, on: Column, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (smaller record first) of rows that fulfil an equality of the aliases a and b, with both sides' columns."""
    a, b = ends()
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in columns]
    return base.alias("a").join(base.alias("b"), on & (a < b)).select(*sides)


def cell_pairs(base: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (smaller record first) of rows with an equal key, with both sides' columns; base must have no equal rows.

    Large blocks are dealt into cells, so that no task has more than a cell's square of one block, and pairs are never
    shuffled: what goes to disk are the rows, once for each CELL members of their block and side.
    """
    side = base.where(F.col(key).isNotNull())
    sizes = side.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    work = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0
    parts = int(min(max(work // PART, 8), 20_000))
    hot = sizes.where(F.col("_n") > CELL).select(key, F.ceil(F.col("_n") / CELL).cast("int").alias("_slots"))  # at most a row for each CELL rows
    side = side.join(F.broadcast(hot), key, "left").withColumn("_slots", F.coalesce("_slots", F.lit(1)))
    own, other = F.pmod(F.xxhash64("source_system", "source_key"), F.col("_slots")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))
    cell = [key, "_i", "_j"]
    sides = [side.withColumn(x, own).withColumn(y, other).select(*dict.fromkeys((*columns, *cell))).repartition(parts, *cell) for x, y in (("_i", "_j"), ("_j", "_i"))]
    a, b = ends()
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cell])
    pairs = sides[0].alias("a").join(sides[1].alias("b"), on & (a < b))
    return pairs.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in columns])


def blocked() -> Column:
    """Whether a pair of rows (columns with the ends _a and _b) shares a block."""
    return reduce(lambda x, y: x | y, [F.coalesce(F.col(f"{k}_a") == F.col(f"{k}_b"), F.lit(False)) for k in KEYS])


def candidate_pairs(base: DataFrame, columns: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Distinct pairs that share a block.

    Each key is a join of its own, and a pair comes from the first key that it shares, so that no join needs a disjunction.
    limit drops blocks with more members, as an option; without it all are compared.
    """
    columns = columns or tuple(base.columns)
    out = []
    for i, key in enumerate(KEYS):
        side = base.where(F.col(key).isNotNull())
        if limit:
            small = side.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= limit).select(key)
            side = side.join(small, key, "left_semi")
        pairs = pair_up(side, F.col(f"a.{key}") == F.col(f"b.{key}"), tuple(dict.fromkeys((*columns, *KEYS))))
        if not limit:
            for earlier in KEYS[:i]:
                pairs = pairs.where(~F.coalesce(F.col(f"{earlier}_a") == F.col(f"{earlier}_b"), F.lit(False)))
        out.append(pairs)
    return reduce(DataFrame.unionByName, out).select(*[f"{c}_{s}" for s in "ab" for c in columns]).distinct()


def tiered_candidates(probes: DataFrame, base: DataFrame, config: MdmConfig) -> DataFrame:
    """For each probe up to `candidate_limit` others by e-mail domain, then phone, then - if these gave fewer than the limit - sound; `candidate_cap` in all.

    Within a tier, others come in the order of their keys, so that the choice is the same every time. A probe can only take
    the first `candidate_limit` others of a block, so a block offers one more than that, whatever its size.
    """
    out = []
    for tier, key in enumerate(_ORDER):
        a, b = ends("p", "c")
        ids = ["source_system", "source_key"]
        asking = probes.where(F.col(key).isNotNull()).select(key, *ids).distinct()
        offered = base.where(F.col(key).isNotNull()).select(key, *ids).distinct()
        place = F.row_number().over(Window.partitionBy(key).orderBy(*ids))
        offered = offered.withColumn("_place", place).where(F.col("_place") <= config.candidate_limit + 1)
        pairs = asking.alias("p").join(offered.alias("c"), (F.col(f"p.{key}") == F.col(f"c.{key}")) & (a != b))
        pairs = pairs.select(*[F.col(f"p.{c}").alias(f"{c}_a") for c in ids], *[F.col(f"c.{c}").alias(f"{c}_b") for c in ids], F.lit(tier).alias("tier")).distinct()
        order = Window.partitionBy("source_system_a", "source_key_a").orderBy("source_system_b", "source_key_b")
        out.append(pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.candidate_limit))
    ids = ["source_system_a", "source_key_a", "source_system_b", "source_key_b"]
    found = reduce(DataFrame.unionByName, out).groupBy(*ids).agg(F.min(F.struct("tier", "place")).alias("first"))
    probe = Window.partitionBy("source_system_a", "source_key_a")
    found = found.withColumn("early", F.sum((F.col("first.tier") < 2).cast("int")).over(probe)).where((F.col("first.tier") < 2) | (F.col("early") < config.candidate_limit))
    ranked = found.withColumn("rank", F.row_number().over(probe.orderBy("first.tier", "first.place", "source_system_b", "source_key_b")))
    return ranked.where(F.col("rank") <= config.candidate_cap).select(*ids, F.col("rank").cast("int").alias("rank"))
