"""Data-quality rules: 100 points, less what rules take away, from 0 to 100."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MdmConfig
from ..functions import text as T
from .survivorship import valid_name

# The patterns of valid e-mails, phones and names.
EMAIL, PHONE, NAME = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$", r"^\+?[0-9]{10,15}$", r"^[A-Za-z '\-]+$"


def customer_rules(config: MdmConfig) -> dict[str, Column]:
    """The points that each rule gives or takes."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    points = lambda when, n: F.when(when, n).otherwise(0)
    email, phone = F.col("email"), F.col("phone")
    good_email = sure(email.rlike(EMAIL))
    nrt = config.mode == "nrt"
    place = F.lower(F.get(F.split(email, "@"), F.lit(1))) if nrt else None
    disposable = place.isin(*config.disposable) if nrt else reduce(lambda a, b: a | b, [F.lower(email).endswith(f"@{d}") for d in config.disposable])
    has_phone = phone != "" if nrt else phone.isNotNull()
    first, last = valid_name("first_name"), valid_name("last_name")
    inside = F.contains(F.lower(email), F.lower(F.trim("first_name")))
    return {
        "dq_001": points(~good_email, -20),
        "dq_002": points(sure(disposable), -5),
        "dq_003": points(~first, -20),
        "dq_004": points(first & ~sure(F.col("first_name").rlike(NAME)), -5),
        "dq_005": points(~last, -20),
        "dq_006": points(last & ~sure(F.col("last_name").rlike(NAME)), -5),
        "dq_007": points(sure(has_phone) & ~sure(F.regexp_replace(phone, "[^0-9+]", "").rlike(PHONE)), -5),
        "dq_008": points(sure(T.digits(phone).isin(*config.placeholders)), -20),
        "dq_c01": points(~good_email & ~sure(F.length(T.digits(phone)) >= 7), -20),
        "dq_c02": points(~first & ~last, -20),
        "dq_x03": points(first & sure(inside), 5),
        "dq_ai01": points(sure(F.col("is_fake_name")) if not nrt else F.lit(False), -20),
    }


def address_rules() -> dict[str, Column]:
    long_enough = F.coalesce(F.length(F.trim("street")) >= 5, F.lit(False))
    return {
        "dq_011": F.when(~long_enough, -5).otherwise(0),
        "dq_012": F.when(F.col("city").isNull(), -20).otherwise(0),
        "dq_x04": F.when(long_enough & F.col("postal_code").isNotNull() & F.col("city").isNotNull(), 10).otherwise(0),
    }


def scored(df: DataFrame, rules: dict[str, Column], keep_rules: bool = False) -> DataFrame:
    """df with dq_score, and each rule's points if asked."""
    total = reduce(lambda a, b: a + b, rules.values(), F.lit(100))
    out = df.withColumns(rules) if keep_rules else df
    return out.withColumn("dq_score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))


def tier(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 70, "Good").when(score >= 50, "Fair").otherwise("Poor")
