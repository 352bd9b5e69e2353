import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions.detect import match_positions, matches
from veilspark.functions.rules import RULES, rules_with
from veilspark.functions.text import is_placeholder, luhn_valid, normalise_key_of, prefix_of
from veilspark.operators.redact import redact_rows

BY_CATEGORY = {r.category: r for r in RULES}


def redacted(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [(r.text, [e.placeholder for e in r.events]) for r in redact_rows(df, **kw).orderBy("i").collect()]


CASES = [
    # evasions, foreign formats, false positives, edges
    ("Contact me at john@gmail.com or 9876543210", "Contact me at EMAIL_1 or PHONE_1"),
    ("Card 4111 1111 1111 1111 and id 2345 6789 0123", "Card CARD_1 and id AADHAAR_1"),
    ("4532 0151 1283 0366", "CARD_1"),
    ("john @ gmail . com", "john @ gmail . com"),
    ("john[at]gmail[dot]com", "john[at]gmail[dot]com"),
    ("98765  43210", "PHONE_1"),
    ("98765-43210 or 98765.43210", "PHONE_1 or PHONE_1"),
    ("(415) 555-2671", "PHONE_1"),
    ("+44 20 7946 0958", "PHONE_1"),
    ("signup+test@company.co.uk", "EMAIL_1"),
    ("Order 4567891230", "Order 4567891230"),
    ("100234567891", "100234567891"),
    ("SKU 1234567890123456", "SKU 1234567890123456"),
    ("at 10:30 in room 204", "at 10:30 in room 204"),
    ("12/09/2026", "12/09/2026"),
    ("", ""),
    ("   ", "   "),
    ("x" * 500 + " a@b.co " + "y" * 500, "x" * 500 + " EMAIL_1 " + "y" * 500),
    ("\U0001f4de 9876543210 \U0001f600", "\U0001f4de PHONE_1 \U0001f600"),
    ("<b>Call 9876543210</b>", "<b>Call PHONE_1</b>"),
    ("JOHN@GMAIL.COM and John@GMail.Com", "EMAIL_1 and EMAIL_1"),
    # the country code stays where no word character comes before it
    ("tel +91 98765 43210", "tel +91 PHONE_1"),
    ("tel+91 98765 43210", "telPHONE_1"),
    ("ring +44 20 7946 0958 now", "ring PHONE_1now"),
    # labels are lower case in running text; honorifics belong to the value
    ("Full Name: Ann Poe", "Full Name: Ann Poe"),
    ("full name: Ann Poe, customer - Bob Lee Roy", "full name: PERSON_1, customer - PERSON_2"),
    ("Dr. Ann Poe", "PERSON_1"),
    # an address runs on over letters of a following placeholder, as it does over any word
    ("12 Park Road, Delhi 9876543210", "ADDRESS_1_1"),
    ("Address: Bar Street", "Address:ADDRESS_1"),
    ("12 Foo Road, address: 5 Bar Street", "ADDRESS_1:ADDRESS_2"),
    # a placeholder can be swallowed by a later rule
    ("4111111111111111@x.com", "EMAIL_1"),
    ("foo@bar.4111111111111111", "EMAIL_1_1"),
    # boundaries are ASCII, white space is wide
    ("é9876543210", "éPHONE_1"),
    ("98765 43210", "PHONE_1"),
    ("tax ABCDE1234F", "tax PAN_1"),
    ("tax ABCDE1234FX", "tax ABCDE1234FX"),
]


def test_cases(spark):
    got = redacted(spark, [c[0] for c in CASES])
    assert [g[0] for g in got] == [c[1] for c in CASES]


def test_null_passes(spark):
    assert redacted(spark, [None]) == [(None, [])]


def test_numbers_follow_first_sight(spark):
    (text, log), = redacted(spark, ["b@x.com a@x.com B@X.com 9876543210 98765-43210 9876543211"])
    assert text == "EMAIL_1 EMAIL_2 EMAIL_1 PHONE_1 PHONE_1 PHONE_2"
    assert log == ["PHONE_1", "PHONE_1", "PHONE_2", "EMAIL_1", "EMAIL_2", "EMAIL_1"]


def test_strict_address(spark):
    prose = "3 of the best items were sold"
    assert redacted(spark, [prose])[0][0] == "ADDRESS_1"
    assert redacted(spark, [prose], rules=rules_with(strict_address=True))[0][0] == prose


def test_many_values_in_one_text(spark):
    text = " ".join(f"user{i}@example.com" for i in range(1500))
    (got, log), = redacted(spark, [text])
    assert got == " ".join(f"EMAIL_{i + 1}" for i in range(1500))
    assert len(log) == 1500


def test_helpers(spark):
    df = spark.createDataFrame(
        [("Email", " A@B.c "), ("phone", "98-76 5.4"), ("pan", "abc"), ("note", "a   b"), ("", "x")],
        "c string, v string",
    )
    rows = df.selectExpr(f"{normalise_key_of('c', 'v')} AS k", f"{prefix_of('c')} AS p").collect()
    assert [(r.k, r.p) for r in rows] == [
        ("a@b.c", "EMAIL"), ("98765" + "4", "PHONE"), ("ABC", "PAN"), ("a b", "NOTE"), ("x", "REDACTED"),
    ]
    flags = spark.createDataFrame(
        [("EMAIL_1",), ("email_22",), ("EMAIL_1\n",), ("x EMAIL_1",), ("a [REDACTED:card] b",), (None,)], "v string"
    ).selectExpr(f"{is_placeholder('v')} AS f").collect()
    assert [r.f for r in flags] == [True, True, False, False, True, False]
    luhn = spark.createDataFrame(
        [("4111-1111-1111-1111",), ("4111111111111112",), ("0",), (None,), ("6304 0000 0000 0000 00",)], "v string"
    ).selectExpr(f"{luhn_valid('v')} AS f").collect()
    assert [r.f for r in luhn][:4] == [True, False, False, False]


def test_positions(spark):
    text = "x 9876543210, é 98765 43211"
    df = spark.createDataFrame([(text,)], "t string")
    (row,) = df.select(F.expr(match_positions("t", BY_CATEGORY["phone"])).alias("m")).collect()
    assert [(m.start, m.length) for m in row.m] == [(2, 10), (16, 11)]
    assert [text[m.start:m.start + m.length] for m in row.m] == ["9876543210", "98765 43211"]


# A second statement of five rules in Python's engine, for random texts.
PY = {
    "card": r"\b(?:\d{4}[-\s]+){3}\d{4}\b|\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "aadhaar": r"\b[2-9]\d{3}[-\s]+\d{4}[-\s]+\d{4}\b|\b[2-9]\d{11}\b",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
}
PIECES = st.sampled_from(
    ["4111", "1111", " ", "-", "2345", "6789", "0123", "@", "a.b", "x.com", ".", "_", "ABCDE", "1234F", "9", "\n", "Z"]
)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=20, max_size=20))
def test_matches_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    exprs = [F.expr(f"transform({_unchecked(c)}, m -> m)").alias(c) for c in PY]
    rows = df.select("i", *exprs).orderBy("i").collect()
    for row, text in zip(rows, texts, strict=True):
        for category, pattern in PY.items():
            assert row[category] == re.findall(pattern, text, re.ASCII), (category, text)


def _unchecked(category):
    from dataclasses import replace

    return matches("t", replace(BY_CATEGORY[category], validate=None))


@pytest.mark.parametrize("category", ["card", "aadhaar", "phone", "email", "pan"])
def test_nothing_left_on_documents(spark, category):
    """After redaction a second pass finds no checkable value."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    again = redact_rows(redact_rows(docs).drop("events"))
    left = again.select(F.explode("events.category").alias("c")).where(F.col("c") == category)
    assert left.count() == 0


@pytest.mark.parametrize("n", [1, 40, 41, 500])
def test_address_label_with_any_number_of_separators(spark, n):
    text = "address" + ":" * n + " Bar Street"
    assert redacted(spark, [text])[0][0] == "address" + ":" * n + "ADDRESS_1"
