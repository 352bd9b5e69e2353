"""Steps whose cost must grow no faster than their tables."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.functions.detect import matches
from veilspark.functions.rules import RULES
from veilspark.operators.gate import gate
from veilspark.plans.derived import form_elements, form_scans
from veilspark.plans.elements import log_count_rows
from veilspark.plans.vision import merged, ocr_results
from veilspark.sources import html
from veilspark.streaming.stateful import FirstEntries


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """A hundred thousand customers in one file."""
    folder = str(tmp_path_factory.mktemp("customers"))
    spark.range(100_000).select(F.col("id").alias("c_custkey"), F.lit("MACHINERY").alias("c_mktsegment")).coalesce(1).write.parquet(
        f"{folder}/customer.parquet"
    )
    return folder


def test_a_small_file_of_customers_is_made_into_forms_by_many_tasks(spark, customers):
    assert form_elements(spark, customers).rdd.getNumPartitions() > 20
    assert ocr_results(spark, customers).rdd.getNumPartitions() > 20


def test_forms_are_grouped_where_they_are_made(spark, customers):
    plan = form_scans(spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_scans_of_a_log_are_counted_where_they_are_made(spark, customers):
    counts = log_count_rows(spark, customers)
    assert "scans" in counts.columns
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # customers are dealt out, sums per task are added up


def test_recognised_results_are_not_sent_to_every_task(spark, customers):
    plan = merged(spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_long_run_of_escapes_takes_no_stack(spark):
    """Twenty thousand escaped blanks and digits, then a leak; greedy groups overflowed the stack."""
    run = r" 7" * 20_000
    df = spark.createDataFrame([('{"elements":[{"text":"' + run + r' jane@example.com"}]}',)], "payload string")
    row = gate(df).select("blocked", F.expr("violations.category").alias("c"), F.expr("violations.index").alias("at")).first()
    assert row["blocked"] and row["c"] == ["email"] and row["at"] == [22 + len(run) + 1]


def test_pages_are_given_out_in_slices():
    """Nodes of a batch of many pages are not all held at once."""
    class Frame:
        def __init__(self, schema):
            self.schema = schema

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    from pyspark.sql.types import StructType
    page = "<p>word</p>" * 1000
    run = html.parse_pages(Frame(StructType.fromDDL("page_id bigint, html string")))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(201)), "html": [page] * 200 + [None]})
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out) <= -(-html.SLICE_LETTERS // len(page))
    assert [i for b in out for i in b.column("page_id").to_pylist()] == list(range(201))
    assert [len(n) for b in out for n in b.column("nodes").to_pylist()] == [1000] * 200 + [0]


def test_a_scans_entries_cost_one_call_each_way():
    """However many keys a scan has, its state is read once and written once a batch."""
    import pandas as pd

    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        state, timers = State(), []

        def getValueState(self, name, kind):  # noqa: N802
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 30

        def getExpiryTimeInMs(self):  # noqa: N802
            return 6

    work, handle = FirstEntries(1000), Handle()
    work.init(handle)
    rows = pd.DataFrame({"target": [f"el_{i}" for i in range(50)] * 2, "category": ["email"] * 100, "at_us": [1000 * (105 - i) for i in range(100)]})
    list(work.handleInputRows((1,), iter([rows]), Times()))
    assert calls == ["get", "update"] and handle.timers == [6]
    handle.timers.clear()
    out = next(work.handleExpiredTimer((1,), Times(), Times()))
    # the first ones of targets 25 .. 49 are at 6 .. 30 ms
    assert sorted(out["first_us"]) == [1000 * i for i in range(6, 31)]
    assert handle.timers == [31]


def test_mail_addresses_side_by_side(spark):
    """What an earlier match leaves of a run may begin the next address."""
    email = next(r for r in RULES if r.category == "email")
    texts = ["a@b.com_x@y.org", "a.b+c@d.co, <e%f@g-h.io>", "@x.com " + "w" * 5000, "ü1@b.de--z@q.net", "a@b@c.de"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(matches("t", email)).alias("m")).collect()
    assert [r["m"] for r in found] == [["a@b.com", "_x@y.org"], ["a.b+c@d.co", "e%f@g-h.io"], [], ["1@b.de", "--z@q.net"], ["b@c.de"]]
