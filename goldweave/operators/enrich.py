"""Enrichers: canonical first names and the detection of fake names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import initcap

# Formal names with their short forms, and names of test accounts.
FORMAL_NAMES = (("William", "Bill"), ("Robert", "Bob"), ("Elizabeth", "Liz"), ("Michael", "Mike"), ("Richard", "Dick"), ("James", "Jim"), ("Margaret", "Peggy"), ("Charles", "Chuck"), ("Theodore", "Ted"))
FAKE_NAMES = ("Test User", "Asdf Qwerty")

Hook = Callable[[Column], Column]


def _lookup(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for formal, short in FORMAL_NAMES for v in (short, formal)])
    return F.coalesce(F.element_at(table, x), x)


def enrich(customers: DataFrame, variant: str = "fuzzy", canonical: Hook | None = None, fake: Hook | None = None) -> DataFrame:
    """customers with canonical_first_name and is_fake_name.

    "fuzzy" only tidies the first name and takes no name for fake. "ai" asks a hook - a model's function, by default a
    small dictionary - for the formal name of each first name of over one letter and whether a full name is fake.
    """
    tidy = initcap(F.trim("first_name"))
    if variant == "fuzzy":
        return customers.withColumn("canonical_first_name", tidy).withColumn("is_fake_name", F.lit(False))
    canonical = canonical or _lookup
    fake = fake or (lambda x: initcap(x).isin(*FAKE_NAMES))
    named = (F.length(F.trim("first_name")) > 0) & (F.length(F.trim("last_name")) > 0)
    full = F.concat(F.trim("first_name"), F.lit(" "), F.trim("last_name"))
    return customers.withColumn("canonical_first_name", F.when(F.length(F.trim("first_name")) > 1, initcap(F.trim(canonical(tidy)))).otherwise(F.col("first_name"))).withColumn(
        "is_fake_name", F.when(named, fake(full)).otherwise(F.lit(False))
    )
