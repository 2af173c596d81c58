"""Match rules, scores and matches; joins that need no comparison of all blocked pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MdmConfig
from ..functions import text as T
from ..sources.session import cut
from .blocking import KEYS, blocked, candidate_pairs, cell_pairs, pair_up
from .ids import numbered

FIELDS = ("source_system", "source_key", "canonical_first_name", "last_name", "email", "phone", "street", "city", "postal_code", "block_soundex", "block_email_domain", "block_phone_suffix")
RULES = ("email_match", "phone_match", "canonical_exact_match", "name_similarity", "soundex_match", "address_similarity", "email_domain_name_match", "phone_partial_city_match")
IDS = ("source_a", "key_a", "source_b", "key_b")
_WEIGHT = "decimal(9,6)"  # of one scale, so that sums stay within a long


def _rule(when: Column, weight) -> Column:
    return F.when(when, F.lit(weight).cast(_WEIGHT)).otherwise(F.lit(0).cast(_WEIGHT))


def _both(column: str, f=lambda x: x) -> tuple[Column, Column]:
    return f(F.col(f"{column}_a")), f(F.col(f"{column}_b"))


def _same(column: str, f=lambda x: x) -> Column:
    a, b = _both(column, f)
    return a == b


def _tidy(config: MdmConfig):
    return (lambda x: F.lower(F.trim(x))) if config.mode == "bulk" else F.lower


def _last_ten(config: MdmConfig):
    """The phone as the rule for ten digits takes it: a leading + counts as a character in bulk mode only."""
    return (lambda x: x) if config.mode == "bulk" else (lambda x: F.replace(x, F.lit("+"), F.lit("")))


def _full(config: MdmConfig, side: str = "") -> Column:
    """A side's whole name, null where a part of it is missing."""
    first, last = (F.col(f"{c}{side}") for c in ("canonical_first_name", "last_name"))
    there = (first != "") & (last != "") if config.mode == "nrt" else first.isNotNull() & last.isNotNull()
    return F.when(there, F.concat(first, F.lit(" "), last))


def _likeness(a: Column, b: Column, config: MdmConfig, f=T.jaro_winkler) -> Column:
    """Jaro-Winkler similarity, in bulk mode in whole per cent."""
    return F.round(f(a, b), 2) if config.mode == "bulk" else f(a, b)


def _with_streets(pairs: DataFrame, config: MdmConfig) -> DataFrame:
    if config.mode != "bulk":
        return pairs
    postal = _same("postal_code")
    return pairs.withColumn("_street_like", _likeness(F.when(postal, F.col("street_a")), F.when(postal, F.col("street_b")), config))


def _keys(config: MdmConfig, side: str = "") -> dict[str, Column]:
    """What the rules compare of a side, null where it counts for none."""
    tidy, phone = _tidy(config), _last_ten(config)(F.col(f"phone{side}"))
    email, full = F.col(f"email{side}"), _full(config, side)
    out = {
        "_email": F.nullif(email, F.lit("")) if config.mode == "nrt" else email,
        "_ten": F.when(F.length(phone) >= 10, F.right(phone, F.lit(10))),
        "_full": full,
        "_canonical": F.when(full.isNotNull(), tidy(F.col(f"canonical_first_name{side}"))),
        "_last": F.when(full.isNotNull(), tidy(F.col(f"last_name{side}"))),
        "_sound": F.col(f"block_soundex{side}"),
        "_domain": T.domain(email),
        "_first": tidy(F.col(f"canonical_first_name{side}")),
    }
    if config.mode == "bulk":
        digits = T.digits(F.col(f"phone{side}"))
        out |= {"_seven": F.when(F.length(digits) >= 7, F.right(digits, F.lit(7))), "_city": tidy(F.col(f"city{side}"))}
    return out


def score_pairs(pairs: DataFrame, config: MdmConfig) -> DataFrame:
    """source_a, key_a, source_b, key_b, a column for each rule, and the score of pairs."""
    pairs = pairs.withColumns({f"{n}{s}": c for s in ("_a", "_b") for n, c in _keys(config, s).items()})
    domains = _same("_domain")
    similar = {"_name_like": _likeness(*_both("_full"), config), "_first_like": _likeness(*[F.when(domains, c) for c in _both("_first")], config)}
    return _scored(_with_streets(pairs.withColumns(similar), config), config)


def _scored(pairs: DataFrame, config: MdmConfig) -> DataFrame:
    """The rules and the score of pairs with both sides' keys and the similarities of their names (_name_like), first names (_first_like) and, in bulk mode, streets (_street_like)."""
    none, name = F.lit(0).cast(_WEIGHT), F.col("_name_like")
    rules = {
        "email_match": _rule(_same("_email"), config.email),
        "phone_match": _rule(_same("_ten"), config.phone),
        "canonical_exact_match": _rule(_same("_last") & _same("_canonical"), config.canonical),
        "name_similarity": F.when(name >= config.name_floor, (F.round(name, 6).cast("decimal(8,6)") * F.lit(config.name).cast("decimal(4,2)")).cast(_WEIGHT)).otherwise(none),
        "soundex_match": _rule(_same("_sound"), config.soundex),
        "address_similarity": _rule(F.col("_street_like") >= config.street_floor, config.address) if config.mode == "bulk" else none,
        "email_domain_name_match": _rule((F.col("_first_like") >= config.first_floor) & _same("_domain"), config.domain_first),
        "phone_partial_city_match": _rule(_same("_seven") & _same("_city"), config.phone_city) if config.mode == "bulk" else none,
    }
    scored = pairs.select(F.col("source_system_a").alias("source_a"), F.col("source_key_a").alias("key_a"), F.col("source_system_b").alias("source_b"), F.col("source_key_b").alias("key_b"), *[c.alias(n) for n, c in rules.items()])
    total = F.greatest(*RULES[:3]) + reduce(lambda x, y: x + y, [F.col(r) for r in RULES[3:]])
    return scored.withColumn("score", total)


#: Entries up to which a table of similar values is broadcast.
SIMILAR = 2_000_000


def _similar(base: DataFrame, value: str, floor: float, config: MdmConfig, most: float) -> tuple[DataFrame, DataFrame] | None:
    """Numbers of a column's distinct values, and the similarity of each two of them that reach the floor, by their numbers; None if there are too many."""
    values = cut(numbered(base.where(F.col(value).isNotNull()).select(value).distinct(), [value], "id"), "values")
    n = values.count()
    if n * n > most:
        return None
    parts = int(min(max(1, n * n // 200_000), 10_000))
    pairs = values.select(F.col(value).alias("x"), F.col("id").alias("i")).repartition(parts, "i").crossJoin(F.broadcast(values.select(F.col(value).alias("y"), F.col("id").alias("j"))))
    found = cut(pairs.select("i", "j", _likeness(F.col("x"), F.col("y"), config, T.jaro_winkler_from(floor - 0.01)).alias("s")).where(F.col("s") >= floor).select((F.shiftleft("i", 32) + F.col("j")).alias("ij"), "s"), "similar")
    return (values, found) if found.count() <= SIMILAR else None


def _with_likes(base: DataFrame, config: MdmConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows with what the rules compare and numbers of their names, and tables of names' similarities by these numbers, without those that are too large."""
    squares = [base.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0 for k in KEYS]
    side, tables = base.withColumns(_keys(config)), {}
    for value, like, floor in (("_full", "_name_like", config.name_floor), ("_first", "_first_like", config.first_floor)):
        if found := _similar(side, value, floor, config, sum(squares) / 2):
            tables[like] = found[1]
            side = side.join(found[0].withColumnRenamed("id", f"{like}_id"), value, "left")
    return side, tables


def match_scores(base: DataFrame, config: MdmConfig) -> DataFrame:
    """Scores of all blocked pairs; their number grows with the square of the blocks' sizes, so matches() doesn't use it unless it must.

    A pair comes from the first of the keys that it shares, so that pairs are never shuffled to find equal ones. Similarities
    of names are looked up among those of distinct names, if these are far fewer than pairs of rows; streets are only
    compared in pairs with an equal postal code, which come from a join of their own.
    """
    if config.drop_large_blocks:
        return score_pairs(candidate_pairs(base, FIELDS, config.block_limit), config)
    base = cut(base.select(*FIELDS).distinct(), "versions")
    side, tables = _with_likes(base, config)
    looked_up = len(tables) == 2
    columns = (*FIELDS[:2], *KEYS, "street", "postal_code", *_keys(config), *[f"{like}_id" for like in tables]) if looked_up else FIELDS
    side = cut(side.select(*columns), "sides") if looked_up else base
    keys, out = (*(("postal_code",) if config.mode == "bulk" else ()), *KEYS), []
    for i, key in enumerate(keys):
        pairs = cell_pairs(side, key, columns)
        pairs = pairs if key in KEYS else pairs.where(blocked())
        for earlier in keys[:i]:
            pairs = pairs.where(~F.coalesce(F.col(f"{earlier}_a") == F.col(f"{earlier}_b"), F.lit(False)))
        if not looked_up:
            out.append(score_pairs(pairs, config))
            continue
        for like, table in tables.items():
            at = F.shiftleft(f"{like}_id_a", 32) + F.col(f"{like}_id_b")
            pairs = pairs.withColumn("ij", at).join(F.broadcast(table.withColumnRenamed("s", like)), "ij", "left").drop("ij")
        out.append(_scored(_with_streets(pairs, config) if key == "postal_code" else pairs.withColumn("_street_like", F.lit(None).cast("double")), config))
    return reduce(DataFrame.unionByName, out)


def _equalities(config: MdmConfig) -> list[list[tuple[str, Column]]]:
    """Sets of keys, each of which a match must agree on one: follows from the weights (see MdmConfig.prunable)."""
    tidy, ten = _tidy(config), _last_ten(config)
    phone = ten(F.col("phone"))
    out = [
        [("email", F.nullif("email", F.lit("")) if config.mode == "nrt" else F.col("email"))],
        [("phone", F.when(F.length(phone) >= 10, F.right(phone, F.lit(10))))],
        [("first", tidy(F.col("canonical_first_name"))), ("last", tidy(F.col("last_name")))],
    ]
    if config.mode == "bulk":
        digits = T.digits(F.col("phone"))
        postal, sound, mail = ("postal", F.col("postal_code")), ("sound", F.col("block_soundex")), ("domain", F.col("block_email_domain"))
        out += [[postal, sound], [postal, mail]] if config.address_needs_block else [[postal]]
        place = [("seven", F.when(F.length(digits) >= 7, F.right(digits, F.lit(7)))), ("city", tidy(F.col("city")))]
        out.append([*place, sound] if config.address_needs_block and config.city_needs_sound else place)
    return out


def _keyed(base: DataFrame, keys: list[tuple[str, Column]]) -> tuple[DataFrame, list[str]]:
    """Rows that have all of some keys, with these as columns, and the columns' names."""
    names = [f"_{n}" for n, _ in keys]
    side = base.withColumns({f"_{n}": c for n, c in keys})
    return side.where(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names])), names


def _equal_pairs(side: DataFrame, names: list[str]) -> DataFrame:
    """Pairs of rows that are equal in the named columns."""
    return pair_up(side, reduce(lambda x, y: x & y, [F.col(f"a.{n}") == F.col(f"b.{n}") for n in names]), FIELDS)


def _accepted(pairs: list[DataFrame], config: MdmConfig) -> DataFrame:
    """Those of the pairs that share a block and whose score is at or over the threshold."""
    candidates = reduce(DataFrame.unionByName, pairs).where(blocked()).distinct()
    return score_pairs(candidates, config).where(F.col("score") >= F.lit(config.threshold)).select(*IDS).distinct()


def matches(base: DataFrame, config: MdmConfig, touched: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of records (source_a, key_a, source_b, key_b) with a score at or over the threshold.

    As the rules on names, sound and domain don't reach the threshold alone, every match has an equal e-mail, phone, name,
    postal code, or number and city, and with one of the last two an equal sound or domain too, so that no pairs are made
    of all in a postal area: pairs come from joins on these, and are held to share a block. With a threshold so
    low that this no longer follows, all blocked pairs are scored. touched (source_system, source_key) asks only for pairs
    with one of these records: rows that share no key with one are left out before the joins.
    """
    base = base.select(*FIELDS).distinct()
    if config.prunable:
        pairs = []
        for keys in _equalities(config):
            side, names = _keyed(base, keys)
            if touched is not None:
                near = side.join(touched, ["source_system", "source_key"], "left_semi").select(*names).distinct()
                side = side.join(near, names, "left_semi")
            pairs.append(_equal_pairs(side, names))
    else:
        pairs = [candidate_pairs(base, FIELDS)]
    found = _accepted(pairs, config)
    if touched is None:
        return found
    ends = [touched.select(F.col("source_system").alias(f"source_{s}"), F.col("source_key").alias(f"key_{s}")) for s in "ab"]
    return found.join(ends[0], ["source_a", "key_a"], "left_semi").unionByName(found.join(ends[1], ["source_b", "key_b"], "left_semi")).select(*IDS).distinct()


#: Blocks that records of an equal e-mail, number or name share, but for odd values.
_IMPLIED = ("block_email_domain", "block_phone_suffix", "block_soundex")


def match_stars(base: DataFrame, config: MdmConfig) -> DataFrame:
    """Links that give the same connected components as matches(), but one for each record and key instead of all pairs.

    An equal e-mail, number or name is a match by itself, if the two share a block; so where all who have a value share its
    block, each is linked with the least record among them, and a placeholder number that many records share costs no more
    than others. Values without one block for all (e-mails without an @) and the remaining rules go through scored pairs.
    """
    if not config.prunable or min(config.email, config.phone, config.canonical) < config.threshold:
        return matches(base, config)
    base = base.select(*FIELDS).distinct()
    own = F.struct("source_system", "source_key")
    equal = _equalities(config)
    stars, pairs = [], []
    for keys, block in zip(equal[:3], _IMPLIED):
        side, names = _keyed(base, keys)
        if config.mode == "nrt":
            side = side.where(reduce(lambda x, y: x & y, [F.col(n) != "" for n in names]))
        one = (F.count(block) == F.count(F.lit(1))) & F.coalesce(F.min(block) == F.max(block), F.lit(False))
        values = side.groupBy(*names).agg(F.min(own).alias("hub"), F.max(own).alias("last"), one.alias("one")).where("hub < last")
        linked = side.join(values.where("one").select(*names, "hub"), names).where(own != F.col("hub"))
        stars.append(linked.selectExpr("hub.source_system source_a", "hub.source_key key_a", "source_system source_b", "source_key key_b"))
        pairs.append(_equal_pairs(side.join(values.where("not one").select(*names), names, "left_semi"), names))
    pairs += [_equal_pairs(*_keyed(base, keys)) for keys in equal[3:]]
    return reduce(DataFrame.unionByName, [*stars, _accepted(pairs, config)]).distinct()


def onehop_stars(base: DataFrame, config: MdmConfig) -> DataFrame:
    """Links that give each record the same least first end as matches().

    The least record of a value is the least first end of all who have it, as long as records and their labels have one
    order. That holds where no system's name begins another's; else it is matches() itself.
    """
    names = base.select("source_system").distinct()
    stems = names.where(F.length("source_system") > 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("source_system") - 1), lambda n: F.substr("source_system", F.lit(1), n))).alias("source_system"))
    return match_stars(base, config) if stems.join(names, "source_system", "left_semi").isEmpty() else matches(base, config)


def rule_counts(scores: DataFrame) -> DataFrame:
    """In how many pairs each rule fires."""
    sums = scores.select(*[F.sum((F.col(r) > 0).cast("long")).alias(r) for r in RULES])
    return sums.selectExpr(f"stack({len(RULES)}, {', '.join(f"'{r}', {r}" for r in RULES)}) as (rule, pairs)").select("rule", F.coalesce("pairs", F.lit(0)).alias("pairs"))


#: Each set of keys that a pair can share; pairs that share a key are those of the sets, with the sign that a set's size gives.
_SETS = tuple(s for n in range(1, len(KEYS) + 1) for s in combinations(KEYS, n))
#: Different names in a group up to which each two of them are looked up; with more, each name's similar ones are.
NAMES = 1000


def _grouped(side: DataFrame, columns: list[str], sets: tuple[tuple[str, ...], ...]) -> tuple[DataFrame, list[str]]:
    """Sizes (n) and signs of groups of rows that are equal in the columns and in a set of keys, nulls being equal to none; the names of the columns that tell the sets and keys apart."""
    keys = [k for k in KEYS if any(k in s for s in sets)]
    found = side.dropna(subset=columns).groupingSets([[*columns, *s] for s in sets], *columns, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).cast("int").alias(f"_no_{k}") for k in keys])
    for k in keys:
        found = found.where((F.col(f"_no_{k}") == 1) | F.col(k).isNotNull()).withColumn(k, F.coalesce(k, F.lit("")))
    shared = len(keys) - reduce(lambda x, y: x + y, [F.col(f"_no_{k}") for k in keys], F.lit(0))
    return found.withColumn("sign", F.when((shared > 0) & (shared % 2 == 0), -1).otherwise(1)), [*keys, *[f"_no_{k}" for k in keys]]


def _count_equal(side: DataFrame, columns: list[str], sets: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Number of pairs of rows that share a set of keys and are equal in the columns."""
    return _grouped(side, columns, sets)[0].select(F.sum(F.expr("sign * (n * (n - 1) div 2)")).alias("pairs"))


def _count_alike(side: DataFrame, columns: list[str], sets: tuple[tuple[str, ...], ...], name: str, alike: DataFrame) -> DataFrame:
    """Number of pairs of rows that share a set of keys, are equal in the columns, and whose names (by number) are alike (i, j with i <= j)."""
    groups, more = _grouped(side, [*columns, name], sets)
    on = [*columns, *more]
    groups = groups.join(groups.groupBy(*on).agg(F.count(F.lit(1)).alias("_names")), on)
    few, many, out = groups.where(F.col("_names") <= NAMES), groups.where(F.col("_names") > NAMES), []
    same = lambda: reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on], F.lit(True))
    pairs = few.alias("a").join(few.alias("b"), same() & (F.col(f"a.{name}") <= F.col(f"b.{name}")))
    pairs = pairs.select("a.sign", F.col(f"a.{name}").alias("i"), F.col(f"b.{name}").alias("j"), F.col("a.n").alias("x"), F.col("b.n").alias("y"))
    out.append(pairs.join(F.broadcast(alike), ["i", "j"]).select("sign", "i", "j", "x", "y"))
    asked = many.withColumnRenamed(name, "i").join(F.broadcast(alike), "i")
    pairs = asked.alias("a").join(many.alias("b"), same() & (F.col("a.j") == F.col(f"b.{name}")))
    out.append(pairs.select("a.sign", "a.i", "a.j", F.col("a.n").alias("x"), F.col("b.n").alias("y")))
    return out[0].unionByName(out[1]).select(F.sum(F.expr("sign * if(i = j, x * (x - 1) div 2, x * y)")).alias("pairs"))


def blocked_rule_counts(base: DataFrame, config: MdmConfig) -> DataFrame:
    """In how many blocked pairs each rule fires: as rule_counts of match_scores, but from the sizes of groups, so that no pairs are made.

    Rows with an equal e-mail, say, and an equal block make n * (n - 1) / 2 pairs. Pairs that share a block are those that
    share a set of keys, added for odd sets and taken off for even ones; pairs of two rows of one record are taken off. Where
    names are similar in one order only, pairs are made of these names' rows alone. In bulk mode, without large blocks or
    with too many different names, pairs are scored.
    """
    weights = (config.email, config.phone, config.canonical, config.name, config.soundex, config.domain_first)
    if config.mode == "bulk" or config.drop_large_blocks or min(weights) <= 0:
        return rule_counts(match_scores(base, config))
    side, tables = _with_likes(cut(base.select(*FIELDS).distinct(), "versions"), config)
    if len(tables) < 2:
        return rule_counts(match_scores(base, config))
    names = [f"{like}_id" for like in tables]
    side = cut(side.select(F.struct("source_system", "source_key").alias("_record"), *KEYS, "_email", "_ten", "_canonical", "_last", *names), "sides")
    again = cut(side.join(side.groupBy("_record").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_record"), "_record", "left_semi"), "again")
    sides, out = [(side, [], 1)] + ([] if again.isEmpty() else [(again, ["_record"], -1)]), []
    alike = {}
    for like, table in tables.items():
        table = table.select(F.shiftright("ij", 32).alias("i"), F.col("ij").bitwiseAND(F.lit(0xFFFFFFFF)).alias("j"))
        back = table.select(F.col("i").alias("j"), F.col("j").alias("i"))
        alike[like] = cut(table.where("i <= j").join(back, ["i", "j"], "left_semi"), "alike"), cut(table.join(back, ["i", "j"], "left_anti"), "oneway")
    for rows, record, sign in sides:
        counts = {
            "email_match": _count_equal(rows, [*record, "_email"], _SETS),
            "phone_match": _count_equal(rows, [*record, "_ten"], _SETS),
            "canonical_exact_match": _count_equal(rows, [*record, "_canonical", "_last"], _SETS),
            "name_similarity": _count_alike(rows, record, _SETS, "_name_like_id", alike["_name_like"][0]),
            "soundex_match": _count_equal(rows, record, (("block_soundex",),)),
            "email_domain_name_match": _count_alike(rows, record, (("block_email_domain",),), "_first_like_id", alike["_first_like"][0]),
        }
        out += [c.select(F.lit(rule).alias("rule"), (sign * F.col("pairs")).alias("pairs")) for rule, c in counts.items()]
    for rule, like, within in (("name_similarity", "_name_like", blocked()), ("email_domain_name_match", "_first_like", _same("block_email_domain"))):
        oneway = alike[like][1]
        if not oneway.isEmpty():
            a, b = (side.select("_record", *KEYS, f"{like}_id").toDF(*[f"{c}_{s}" for c in ("_record", *KEYS)], n) for s, n in (("a", "i"), ("b", "j")))
            found = a.join(F.broadcast(oneway), "i").join(b, "j").where((F.col("_record_a") < F.col("_record_b")) & within)
            out.append(found.select(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("pairs")))
    every = side.sparkSession.createDataFrame([(r, 0) for r in RULES], "rule string, pairs long")
    return reduce(DataFrame.unionByName, [every, *out]).groupBy("rule").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def unsuppressed(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Matches without those that a suppression names, in either order."""
    a, b = (F.struct(F.col(f"source_system_{s}").alias("s"), F.col(f"source_key_{s}").alias("k")) for s in "ab")
    norm = suppressions.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).selectExpr("x.s source_a", "x.k key_a", "y.s source_b", "y.k key_b")
    return found.join(norm, list(IDS), "left_anti")
