"""Streaming queries, run over all present input; their twins are the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import redact
from ..operators.numbering import evaluate_once
from ..streaming.common import run_folder, run_to_table, stream_table
from ..streaming.redact import start_gated_sinks
from ..streaming.stateful import first_entries, session_loop, token_registry
from . import actions, documents
from . import oracle as o
from .actions import LOOP_RECORDS
from .documents import SPLICED


def stream_redact(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through redaction and gate into two sinks, read back with their sink."""
    stream = stream_table(spark, folder, "documents").select("doc_id", "text")
    out = run_folder(spark, "redact")
    start_gated_sinks(stream, out).awaitTermination()
    passed = spark.read.schema("doc_id bigint, text string, batch bigint").parquet(f"{out}/passed")
    held = spark.read.schema("doc_id bigint, batch bigint").parquet(f"{out}/quarantine")
    return passed.select("doc_id", "text", F.lit("passed").alias("sink")).unionByName(
        held.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit("quarantine").alias("sink"))
    )


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    records = spark.sql(LOOP_RECORDS, events=stream_table(spark, folder, "events"))
    return run_to_table(session_loop(records), "sessions")


def stream_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers per conversation and prefix, without the digests: how many, how dense."""
    turns = spark.sql(
        SPLICED,
        conversations=stream_table(spark, folder, "conversations"),
        # short rows that become turns: dealt out first, a micro-batch of them is one split or two
        customer=stream_table(spark, folder, "customer").select("c_custkey").repartition(
            int(spark.conf.get("spark.sql.shuffle.partitions"))
        ),
    )
    events = evaluate_once(turns, _fold=redact("text")).select(
        F.col("conv_id").alias("scan_id"), F.col("turn").alias("position"),
        F.posexplode("_fold.events").alias("seq", "e"),
    ).select(
        "scan_id", "position", "seq", "e.prefix", "e.token",
        F.timestamp_seconds(F.col("position") * 60).alias("ts"),
    )
    numbers = run_to_table(token_registry(events), "registry")
    return numbers.groupBy("scan_id", "prefix").agg(
        F.count(F.lit(1)).alias("numbers"), F.max("n").alias("highest"),
        F.countDistinct("token").alias("tokens"),
    )


DEDUPE = """
SELECT user_id AS scan_id, 'el_' || lpad(CAST(event_id % 9 AS STRING), 3, '0') AS target,
  event_type AS category, ts FROM {events}"""


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first log entry of each key; entries of the last ten minutes still wait."""
    log = spark.sql(DEDUPE, events=stream_table(spark, folder, "events"))
    return run_to_table(first_entries(log), "dedupe").select(
        "scan_id", "target", "category", F.unix_micros("ts").alias("first_us")
    )


# What the watermark has passed when the input is used up, in milliseconds.
PASSED = "(SELECT epoch_ms(max(ts)) - 600000 FROM events)"


def _sql() -> dict[str, str]:
    with_, last = documents._doc_fold()
    left_over = documents.positions_sql("t", f"(SELECT doc_id, texts[1] AS t FROM {last})", "doc_id")
    spliced = SPLICED.format(conversations="conversations", customer="customer")
    ctes, conv_last = o.fold_sql("grouped", ["conv_id"])
    per_prefix = " UNION ALL ".join(
        f"SELECT conv_id AS scan_id, '{p}' AS prefix, len(dk_{c}) AS numbers, len(dk_{c}) AS highest, "
        f"len(dk_{c}) AS tokens FROM {conv_last} WHERE len(dk_{c}) > 0"
        for c, p in o.PREFIX.items()
    )
    return {
        "stream_redact": f"""
{with_}, bad AS (SELECT DISTINCT doc_id FROM ({left_over}))
SELECT doc_id, CASE WHEN bad.doc_id IS NULL THEN texts[1] END AS text,
  CASE WHEN bad.doc_id IS NULL THEN 'passed' ELSE 'quarantine' END AS sink
FROM {last} LEFT JOIN bad USING (doc_id)""",
        "stream_sessions": f"""
SELECT s.* FROM ({actions.ORACLE["session_steps"]}) s JOIN events ON event_id = record_id WHERE epoch_ms(ts) <= {PASSED}""",
        "stream_registry": f"""
WITH spliced AS ({spliced}),
grouped AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM spliced GROUP BY conv_id), {ctes} {per_prefix}""",
        "stream_dedupe": f"""
SELECT scan_id, target, category, epoch_us(min(ts)) AS first_us FROM ({DEDUPE.format(events='events')})
GROUP BY ALL HAVING epoch_ms(min(ts)) <= {PASSED}""",
    }


QUERIES = {
    "stream_redact": stream_redact,
    "stream_sessions": stream_sessions,
    "stream_registry": stream_registry,
    "stream_dedupe": stream_dedupe,
}
ORACLE = _sql()
