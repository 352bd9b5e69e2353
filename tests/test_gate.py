import json

import pytest

from veilspark.operators import search
from veilspark.operators.audits import secret_audit
from veilspark.operators.gate import gate, split_gate
from veilspark.session import staged
from veilspark.sources.payloads import payload_scans, read_payloads, write_log, write_payloads, write_telemetry


def verdicts(spark, *payloads, **kw):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "i int, payload string")
    return gate(df, **kw).orderBy("i").collect()


def page(**element):
    return {"context": {"elements": [{"id": "el_001", **element}]}}


@pytest.mark.parametrize("text,category", [
    ("mail a@b.co", "email"), ("card 4111 1111 1111 1111", "card"), ("+91 9876543210", "phone"),
    ("2345 6789 0123", "aadhaar"), ("ABCDE1234F", "pan"),
])
def test_a_leak_is_blocked(spark, text, category):
    (v,) = verdicts(spark, page(text=text))
    assert v.blocked and not v.success and v.reason == "privacy_violation"
    assert category in [x.category for x in v.violations]
    assert all(text not in str(x) for x in v.violations)


def test_structural_rules(spark):
    got = verdicts(
        spark,
        page(type="password", value="PASSWORD_1"),
        page(type="password", value=None),
        page(type="password"),
        page(sensitive=True, value="open"),
        page(sensitive=True, value="EMAIL_1"),
        page(sensitive=True, value="c/o EMAIL_1 x"),
        page(sensitive=True, value="[REDACTED:name]"),
        page(tag="canvas", visualScanFailed=True),
        page(tag="canvas", visualScanFailed=True, sensitive=True),
        {"elements": [{"category": "payment", "value": ""}]},
    )
    assert [v.blocked for v in got] == [True, True, False, True, False, False, False, False, True, True]


def test_clean_and_odd_payloads(spark):
    got = verdicts(
        spark, page(text="order 4567891230, 12/09/2026, SKU 1234567890123456"), "not json", "not json a@b.co",
        None, "",
    )
    assert [v.blocked for v in got] == [False, False, True, True, True]
    assert got[3].reason == "empty_payload"
    assert [v.blocked for v in verdicts(spark, None, "", compat=True)] == [False, False]


def test_escapes(spark):
    """A number after an escaped line break is seen in decoded mode only."""
    leak = page(text="call\n9876543210 \\n \"9876543211\" \\\\9876543212")
    assert verdicts(spark, leak)[0].violationsCount == 3
    assert verdicts(spark, page(text="x\n9876543210"), mode="serialized")[0].violationsCount == 0


@pytest.mark.parametrize("text,category", [
    (r"john\u0040gmail.com", "email"), (r"98765432\u0031\u0030", "phone"), (r"x\u00a09876543210", "phone"),
    (r"x\u20039876543210", "phone"), (r"4111\u00201111\u20071111\u00091111", "card"),
    (r"\u0032345 6789 0123", "aadhaar"), (r"\u0041BCDE1234\u0046", "pan"), (r"\ud83d\ude00a@b.co", "email"),
    (r"\ud83da@b.co", "email"), (r"\\u0040 a@b.co", "email"),
])
def test_unicode_escapes(spark, text, category):
    whole = '{"elements":[{"text":"' + text + '"}]}'
    for payload in (whole, whole[:-3]):  # parsable or not
        (v,) = verdicts(spark, payload)
        assert v.blocked and category in [x.category for x in v.violations]


def test_escaped_backslash_is_no_escape(spark):
    assert not verdicts(spark, r'{"text":"john\\u0040gmail.com"}')[0].blocked


def test_sinks(spark, tmp_path):
    rows = [(1, json.dumps(page(text="fine"))), (2, json.dumps(page(text="a@b.co")))]
    gated = gate(spark.createDataFrame(rows, "scan_id int, payload string"))
    passed, held = split_gate(gated)
    assert passed.count() == 1 and "payload" not in held.columns
    write_payloads(gated, f"{tmp_path}/out", f"{tmp_path}/held")
    assert read_payloads(spark, f"{tmp_path}/out").count() == 1
    assert "a@b.co" not in "".join(r.value for r in spark.read.text(f"{tmp_path}/held").collect())
    log = spark.createDataFrame([("el_001", "email", 1.0, "dom", "EMAIL_1", "#x")],
                                "id string, category string, confidence double, source string, placeholder string, selector string")
    write_log(log, f"{tmp_path}/log")
    assert "selector" not in spark.read.parquet(f"{tmp_path}/log").columns


def test_the_gate_runs_once_and_stages_no_blocked_payload(spark, tmp_path, monkeypatch):
    from veilspark.sources import payloads

    kept = []
    monkeypatch.setattr(payloads, "staged", lambda df, name: kept.append(staged(df, name)) or kept[0])
    rows = [(1, json.dumps(page(text="fine"))), (2, json.dumps(page(text="a@b.co")))]
    write_payloads(gate(spark.createDataFrame(rows, "scan_id int, payload string")), f"{tmp_path}/out", f"{tmp_path}/held")
    assert {r.scan_id: r.payload is None for r in kept[0].collect()} == {1: False, 2: True} and len(kept) == 1


def test_telemetry_is_appended(spark, tmp_path):
    from veilspark.operators.sessions import latest_telemetry

    row = dict(session_id=1, record_id=1, ts=1, step=1, action="CLICK", target="el_001", status="success", rejection=None)
    steps = spark.createDataFrame([row], "session_id int, record_id int, ts int, step int, action string, target string, status string, rejection string")
    for _ in range(2):
        write_telemetry(latest_telemetry(steps), f"{tmp_path}/progress")
    got = spark.read.parquet(f"{tmp_path}/progress").collect()
    assert [(r.session_id, r.step, r.status, r.timestamp is not None) for r in got] == [(1, 1, "success", True)] * 2


def test_presence_of_value(spark):
    text = '{"url":"u","elements":[{"id":"a","value":null},{"id":"b"}]}'
    df = payload_scans(spark.createDataFrame([(text,)], "payload string"))
    row = df.first()
    assert row.url == "u" and [e.has_value for e in row.elements] == [True, False]


def test_secrets_with_a_common_start(spark):
    """Secrets that share thirty letters are anchored where they differ."""
    head = "x" * 30
    secrets = spark.range(500).selectExpr(f"concat('{head}', lpad(id, 6, '0')) AS secret")
    rows = [(i, f"a {head}{i:06d} b") for i in range(0, 1000, 50)]
    hits = secret_audit(spark.createDataFrame(rows, "i int, payload string"), secrets, "i").collect()
    assert sorted(r.i for r in hits) == list(range(0, 500, 50))


def test_secret_audit_small_and_large(spark):
    payloads = spark.createDataFrame(
        [(1, "xx top secret phrase yy ab"), (2, "nothing"), (3, "SECRET-000599 and SECRET-0005999")], "i int, payload string"
    )
    few = spark.createDataFrame([("secret phrase",), ("ab",), ("zz",)], "secret string")
    assert sorted(r.i for r in secret_audit(payloads, few, "i").collect()) == [1, 1]
    many = spark.range(800).selectExpr("concat('SECRET-', lpad(id, 6, '0')) AS secret").unionByName(few)
    assert sorted(r.i for r in secret_audit(payloads, many, "i").collect()) == [1, 1, 3]


def _found(texts, strings):
    return sorted((k, s) for k, t in texts for s in strings if s and t and s in t)


def test_search_against_plain_containment(spark, monkeypatch):
    """One automaton and many shards give what looking for each string gives; strings hold each
    other, keys repeat, texts are null, empty and long."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    strings = list({word(rng.randint(1, 7)) for _ in range(150)} - {""})
    texts = [(i % 40, word(rng.randint(0, 80))) for i in range(60)] + [(90, None), (91, ""), (92, word(20_000))]
    df = spark.createDataFrame(texts, "k int, body string")
    wanted = spark.createDataFrame([(s, s) for s in strings] + [("", "none"), (None, "none")], "s string, m string")
    for size in (search.SHARD_BYTES, 60):
        monkeypatch.setattr(search, "SHARD_BYTES", size)
        rows = search.search(df.repartition(3), wanted, "k", "body", "s", "m").collect()
        assert sorted((r.k, r.m) for r in rows) == _found(texts, strings)
        assert search.search(df.where("false"), wanted, "k", "body", "s", "m").count() == 0
        assert search.search(df, wanted.where("false"), "k", "body", "s", "m").count() == 0


def test_a_hundred_thousand_secrets(spark):
    """Short ones included; each payload holds a known few."""
    secrets = spark.range(100_000).selectExpr("concat('key-', lpad(hex(id * 2654435761 % 1048576), 6, 'Q'), '-', id) AS secret")
    short = spark.createDataFrame([("~",), ("#7",), ("zq",)], "secret string")
    rows = spark.range(2000).selectExpr(
        "id", "concat_ws(' ', repeat('lorem ipsum ', 40), concat('key-', lpad(hex(id * 50 * 2654435761 % 1048576), 6, 'Q'), '-', id * 50), "
        "if(id % 100 = 0, '~ zq', '')) AS payload"
    )
    hits = secret_audit(rows, secrets.unionByName(short), "id").groupBy("id").count().collect()
    assert len(hits) == 2000
    for r in hits:
        # key-...-0, -50, -500 begin longer ones only where the id goes on
        number = str(r["id"] * 50)
        heads = sum(1 for n in range(1, len(number) + 1) if _key(int(number[:n])) in _key(int(number)))
        assert r["count"] == heads + (2 if r["id"] % 100 == 0 else 0)


def _key(i):
    return f"key-{(i * 2654435761) % 1048576:X}".replace("key-", "key-" + "Q" * (6 - len(f"{(i * 2654435761) % 1048576:X}"))) + f"-{i}"


def test_places_lead_into_the_stored_payload(spark):
    """Escapes of every kind before, in and after a leak; the letter at its index is its first."""
    from pyspark.sql import functions as F

    from veilspark.operators.gate import gate

    mail = "jane@example.com"
    before = ["", "plain ", r"a\n\t\"b\\ ", r"é中 ", r"😀 ", r"\\n \\\" ", r" \/\b ", "é😀 ", r"\\\\\\ " * 50]
    rows = []
    for i, head in enumerate(before):
        for leak, first in ((mail, "jane"), (mail.replace("@", r"@"), "jane"), (mail.replace("j", r"j", 1), r"j")):
            rows.append((i, '{"elements":[{"text":"' + head + leak + r' \n end"}]}', first))
    df = spark.createDataFrame(rows, "i int, payload string, first string")
    found = gate(df).select("payload", "first", F.explode("violations").alias("v")).select("payload", "first", "v.index").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["payload"][r["index"] :].startswith(r["first"]), (r["payload"][:60], r["index"])


def test_many_secrets_neither_repeat_payloads_nor_meet_them_as_lists(spark, monkeypatch):
    """Strings beyond one automaton: payloads stay where they are, whatever the number of strings."""
    monkeypatch.setattr(search, "SHARD_BYTES", 60)
    wanted = spark.range(3000).selectExpr("concat('secret ', id) AS s", "CAST(id AS STRING) AS m")
    texts = spark.range(50).selectExpr("id AS k", "concat('é secret ', id * 60, '.') AS body")
    found = search.search(texts, wanted, "k", "body", "s", "m")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan
    got = {(r["k"], r["m"]) for r in found.collect()}
    assert got == {(k, str(k * 60)[:n]) for k in range(50) for n in range(1, 6)}
