"""Scans of many rows, skewed scans, element scans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspark.operators.numbering import rank_by_chunks
from veilspark.operators.redact import redact_rows, redact_scans
from veilspark.operators.sanitize import ELEMENT, log_counts, redaction_log, sanitize_scans


@pytest.fixture(scope="module")
def turns(spark):
    """One scan holds most rows; its values repeat and also appear late."""
    hot = spark.range(600).selectExpr(
        "1 AS scan", "id AS turn",
        "concat('mail u', id % 37, '@x.com or ', id * id % 101, '@y.org, ', 9876500000 + id % 5) AS text",
    )
    cold = spark.range(60).selectExpr("2 + id % 7 AS scan", "id AS turn", "concat('plain ', id, ' z@z.com') AS text")
    return hot.unionByName(cold)


def brute_force(rows):
    """Number e-mails and phones by walking each scan in order."""
    import re

    seen, out = {}, {}
    for scan, turn, text in sorted(rows):
        for prefix, pattern in (("PHONE", r"\b98765\d{5}\b"), ("EMAIL", r"\w+@\w\.\w+")):
            def number(m, scan=scan, prefix=prefix):
                known = seen.setdefault((scan, prefix), {})
                return f"{prefix}_{known.setdefault(m[0], len(known) + 1)}"

            text = re.sub(pattern, number, text)
        out[scan, turn] = text
    return out


@pytest.mark.parametrize("chunk", [2, 16, 1024])
def test_scans_match_a_walk(spark, turns, chunk):
    want = brute_force([tuple(r) for r in turns.collect()])
    got = {(r.scan, r.turn): r.text for r in redact_scans(turns, ["scan"], "turn", chunk=chunk).collect()}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_partition_count_does_not_matter(spark, turns, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = redact_scans(turns.repartition(partitions), ["scan"], "turn", chunk=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = brute_force([tuple(r) for r in turns.collect()])
    assert {(r.scan, r.turn): r.text for r in rows} == want


def test_rank_by_chunks_is_row_number(spark):
    keys = spark.range(500).selectExpr("id % 3 AS g", "pmod(hash(id), 90) AS pos", "id AS tie")
    got = rank_by_chunks(keys, ["g"], "pos", ["tie"], "n", chunk=4)
    want = keys.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("pos", "tie")))
    assert sorted(map(tuple, got.select("g", "pos", "tie", "n").collect())) == sorted(map(tuple, want.collect()))


def test_no_shuffle_for_single_row_scans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = redact_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def element(**kw):
    names = [f.split(":")[0] for f in ELEMENT[len("struct<"):-1].split(",")]
    row = {n: None for n in names} | {"sensitive": False, "has_value": "value" in kw} | kw
    return tuple(row[n] for n in names)


def sanitized(spark, *elements):
    df = spark.createDataFrame([(1, list(elements))], f"scan_id int, elements array<{ELEMENT}>")
    return sanitize_scans(df).first()


def test_fixture_page(spark):
    row = sanitized(
        spark,
        element(id="el_001", tag="h2", text="Welcome back, test.user@example.com!"),
        element(id="el_002", tag="p", text="reach out at 9999999999 directly."),
        element(id="el_003", tag="p", text="on file: 4111111111111111"),
        element(id="el_004", tag="p", text="recorded: 234567891012 verified"),
        element(id="el_005", tag="input", type="password", sensitive=True, category="password",
                text="Enter Password", value="secret"),
        element(id="el_006", tag="p", text="TEST.USER@example.com and bob.smith@example.com"),
    )
    assert [e.text for e in row.elements] == [
        "Welcome back, EMAIL_1!", "reach out at PHONE_1 directly.", "on file: CARD_1",
        "recorded: AADHAAR_1 verified", "PASSWORD_1", "EMAIL_1 and EMAIL_2",
    ]
    assert all(e.sensitive for e in row.elements)
    assert row.elements[4].value is None and not row.elements[4].has_value
    # the second value of el_006 is not logged: one entry per element and category
    assert [(r.id, r.category, r.placeholder) for r in row.redactions] == [
        ("el_001", "email", "EMAIL_1"), ("el_002", "phone", "PHONE_1"), ("el_003", "card", "CARD_1"),
        ("el_004", "aadhaar", "AADHAAR_1"), ("el_005", "password", "PASSWORD_1"),
        ("el_006", "email", "EMAIL_1"),
    ]


def test_form_scope(spark):
    row = sanitized(
        spark,
        element(id="a", tag="input", label="mail me@x.com", value="call 9876543210"),
        element(id="b", tag="input", label="Full Name", value="Jane  Doe"),
        element(id="c", tag="input", label="Full Name", value="jane doe"),
        element(id="d", tag="textarea", label="Home address", value="Hill House"),
        element(id="e", tag="input", label="Email address", value="nobody"),
        element(id="f", tag="input", name="name", value="Jane Doe"),
        element(id="g", tag="textarea", label="street", value="c/o a@b.co"),
        element(id="h", tag="textarea", label="street", value="a@b.co"),
    )
    assert [e.value for e in row.elements] == [
        "call PHONE_1", "PERSON_1", "jane doe", "ADDRESS_1", "nobody", "PERSON_1", "ADDRESS_2", "EMAIL_1",
    ]
    assert row.elements[0].label == "mail me@x.com"
    assert [e.sensitive for e in row.elements] == [True, True, False, True, False, True, True, True]


def test_payment_shares_card_numbers_and_own_categories_count(spark):
    row = sanitized(
        spark,
        element(id="a", tag="p", text="4111111111111111"),
        element(id="b", tag="input", sensitive=True, category="payment", text="x"),
        element(id="c", tag="p", text="4532 0151 1283 0366"),
        element(id="d", tag="p", sensitive=True, category="otp", text="x"),
        element(id="e", tag="p", sensitive=True, category="otp", text="y"),
        element(tag="p", sensitive=True, text="y"),
    )
    assert [e.text for e in row.elements] == ["CARD_1", "CARD_2", "CARD_3", "OTP_1", "OTP_2", "PASSWORD_1"]
    assert row.redactions[-1].id == "unknown" and row.redactions[-1].category == "sensitive"


def test_missing_elements_count_as_empty(spark):
    df = spark.createDataFrame([(1, None)], f"scan_id int, elements array<{ELEMENT}>")
    row = sanitize_scans(df).first()
    assert row.elements == [] and row.redactions == [] and row.totalElements == 0


def test_log_counts_give_entries_and_distinct_scans(spark):
    """A scan counts once a category however many entries it has; scans without a key are one."""
    texts = [(1, ["a@x.com", "b@x.com", "9876543210"]), (2, ["a@x.com"]), (3, ["plain"]), (None, ["c@x.com", "d@x.com"])]
    df = spark.createDataFrame(
        [(scan, [element(id=f"el_{i}", tag="p", text=t) for i, t in enumerate(ts)]) for scan, ts in texts],
        f"scan_id int, elements array<{ELEMENT}>",
    )
    counts = log_counts(redaction_log(sanitize_scans(df), ["scan_id"])).collect()
    assert {(r.category, r.confidence, r.source): (r.entries, r.scans) for r in counts} == {
        ("email", 1.0, "dom"): (5, 3), ("phone", 1.0, "dom"): (1, 1),
    }


def test_log_counts_tell_scans_by_their_whole_key(spark):
    log = spark.createDataFrame(
        [("p", 1, "email", 1.0, "dom"), ("p", 1, "email", 1.0, "dom"), ("p", 2, "email", 1.0, "dom"),
         ("q", 1, "email", 1.0, "dom"), ("p", 1, "email", 1.0, "vision"), ("q", None, None, 0.7, "dom")],
        "page string, frame int, category string, confidence double, source string",
    )
    assert {tuple(r) for r in log_counts(log, ["page", "frame"]).collect()} == {
        ("email", 1.0, "dom", 4, 3), ("email", 1.0, "vision", 1, 1), (None, 0.7, "dom", 1, 1),
    }


def test_log_counts_of_an_empty_log(spark):
    log = spark.createDataFrame([], "scan_id int, category string, confidence double, source string")
    assert log_counts(log).columns[-2:] == ["entries", "scans"] and log_counts(log).count() == 0
