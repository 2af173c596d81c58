"""Column functions on values with known results."""

import pytest
from pyspark.sql import functions as F

from goldweave.config import BULK, NRT
from goldweave.functions import text as T
from goldweave.operators import normalize, quality
from goldweave.sources.readers import clear_tokens


def values(spark, column, inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in frame.select(column.alias("y"), "i").orderBy("i").select("y").collect()]


@pytest.mark.parametrize(
    "column, cases",
    [
        (lambda x: T.initcap(x), {"bill": "Bill", "WILLIAM": "William", "o'neil mary-jane": "O'Neil Mary-Jane", "": "", None: None, "élan école": "Élan École"}),
        (lambda x: normalize._capital(x, "nrt"), {"  john  ": "John", " ": None, None: None, "bill": "Bill"}),
        (lambda x: T.email(x, "nrt"), {"  Bill@ACME.com  ": "bill@acme.com", "  ": None, None: None}),
        (lambda x: T.email(x, "bulk"), {" A@B.c": "a@b.c", "  ": ""}),
        (lambda x: T.phone(x, "nrt"), {"+1 (104) 332-1819": "+11043321819", "abc": None, None: None}),
        (lambda x: T.phone(x, "bulk"), {"abc": "", None: None}),
        (lambda x: F.soundex(x), {"Smith": "S530", "Smth": "S530", "Ashcraft": "A261", "": ""}),
        (lambda x: T.domain(x), {"bill@acme.com": "@acme.com", "none": None, None: None, "a@b@c": "@b@c"}),
        (lambda x: T.phone_suffix(x), {"+11043321819": "1819", "123": None, None: None}),
        (lambda x: T.first_word(x), {"William Smith": "William", "Madonna": "Madonna", " x": ""}),
        (lambda x: T.other_words(x), {"William Smith": "Smith", "Madonna": None, "A b  c": "b  c"}),
        (lambda x: T.file_date(x).cast("string"), {"2024-01-31_crm_a_customers.csv": "2024-01-31", "bad_crm_a.csv": None, "2024-02-31_crm_b.csv": None, None: None}),
        (lambda x: T.null_tokens(x, ("", "NULL")), {"": None, "NULL": None, "null": "null", "x": "x", None: None}),
        (lambda x: quality.tier(x.cast("int")), {"90": "Excellent", "89": "Good", "70": "Good", "50": "Fair", "49": "Poor"}),
    ],
)
def test_values(spark, column, cases):
    assert values(spark, column(F.col("x")), list(cases)) == list(cases.values())


@pytest.mark.parametrize("a, b, want", [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("DWAYNE", "DUANE", 0.84), ("", "", 1.0), ("a", "", 0.0), ("same", "same", 1.0), ("abc", "xyz", 0.0), ("日本語", "日本", 0.911111)])
def test_jaro_winkler_values(a, b, want):
    assert abs(T.similarity([a], [b])[0] - want) < 1e-6 and abs(T.similarity([b], [a])[0] - want) < 1e-6


def plain_jaro_winkler(a, b):
    if not a and not b:
        return 1.0
    reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_against_plain_python():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    word = st.text(alphabet="abcdé 日", max_size=14)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.tuples(word, word), min_size=1, max_size=20))
    def holds(pairs):
        got = T.similarity([a for a, _ in pairs], [b for _, b in pairs])
        assert all(abs(g - plain_jaro_winkler(a, b)) < 1e-9 for g, (a, b) in zip(got, pairs, strict=True))

    holds()


def test_udf_keeps_nulls(spark):
    frame = spark.createDataFrame([("ab", None), (None, None), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in frame.select(T.jaro_winkler("a", "b")).collect()] == [None, None, 1.0]


CLEAN = {"first_name": "William", "last_name": "Smith", "email": "william@acme.com", "phone": "+11043321819"}


@pytest.mark.parametrize(
    "config, change, score",
    [
        (NRT, {}, 100),
        (NRT, {"email": "bill@mailinator.com"}, 95),
        (NRT, {"phone": "1111111111"}, 85),
        (NRT, {"email": None, "phone": None}, 60),
        (NRT, {"first_name": None, "last_name": None}, 40),
        (NRT, {"first_name": "W1lliam"}, 95),
        (NRT, {"email": "@broken"}, 80),
        (NRT, {"email": "no-at-sign"}, 80),
        (NRT, {"email": "user+tag@sub.domain.co.uk"}, 100),
        (NRT, {"first_name": "José", "email": "x@acme.com"}, 95),
        (NRT, dict.fromkeys(CLEAN), 0),
        (NRT, dict.fromkeys(CLEAN, ""), 0),
        (BULK, {"is_fake_name": True}, 85),
    ],
)
def test_quality_scores(spark, config, change, score):
    row = CLEAN | {"is_fake_name": False} | change
    frame = spark.createDataFrame([tuple(row.values())], "first_name string, last_name string, email string, phone string, is_fake_name boolean")
    found = quality.scored(frame, quality.customer_rules(config)).first().dq_score
    assert found == score


def test_clear_tokens_by_source(spark):
    raw = spark.createDataFrame([("N/A", "null", "N/A_crm_c.csv")], "a string, b string, _source_file string")
    assert tuple(clear_tokens(raw, "CRM_C").first()) == (None, None, "N/A_crm_c.csv")
    assert tuple(clear_tokens(raw, "CRM_A").first()) == ("N/A", None, "N/A_crm_c.csv")
