"""Payload JSON: reading captured payloads, assembling and writing outgoing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sanitize import ELEMENT
from ..session import staged

_REDACTION = "struct<id:string,category:string,confidence:double,source:string,placeholder:string>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload per line of text, kept whole: the gate scans what it cannot parse."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def payload_scans(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload JSON to scans: ``context.elements``, else ``elements``, else none.

    ``has_value`` is taken from the keys present, so a null value still counts.
    """
    shape = (
        "url string, title string, extractedAt timestamp, elements array<string>, "
        "context struct<url:string,title:string,extractedAt:timestamp,elements:array<string>>"
    )
    element = ELEMENT[len("struct<"):-1].replace(":", " ")
    doc = payloads.withColumn("_p", F.from_json(payload, shape))
    raw = F.coalesce("_p.context.elements", "_p.elements", F.expr("CAST(array() AS array<string>)"))
    parsed = F.transform(
        raw,
        lambda j: F.from_json(j, element).withField(
            "has_value",
            F.coalesce(F.array_contains(F.json_object_keys(j), "value"), F.lit(False)),
        ),
    )
    return doc.select(
        *payloads.columns,
        F.coalesce("_p.context.url", "_p.url").alias("url"),
        F.coalesce("_p.context.title", "_p.title").alias("title"),
        F.coalesce("_p.context.extractedAt", "_p.extractedAt").alias("extractedAt"),
        parsed.cast(f"array<{ELEMENT}>").alias("elements"),
    )


def outgoing_payloads(scans: DataFrame, keys: list[str], action: str = "PLAN_ACTION") -> DataFrame:
    """Assemble the outgoing JSON. Working columns (presence flag, selector) stay out, and
    nulls are not written, so a purged value leaves no key behind.

    Optional columns: goal, tab_id, history, step, timestamp.
    """
    have = set(scans.columns)

    def opt(name: str, default: str) -> Column:
        return F.col(name) if name in have else F.expr(default).alias(name)

    elements = F.transform("elements", lambda e: e.dropFields("has_value", "selector"))
    log = (
        F.transform("redactions", lambda r: r.dropFields("selector"))
        if "redactions" in have else F.expr(f"CAST(array() AS array<{_REDACTION}>)")
    )
    context = F.struct(
        opt("url", "''"), opt("title", "''"),
        F.size("elements").alias("totalElements"),
        elements.alias("elements"), log.alias("redactions"),
    )
    tab = F.struct(
        opt("tab_id", "CAST(NULL AS INT)").alias("id"), opt("url", "''"), opt("title", "''")
    )
    body = F.struct(
        F.lit(action).alias("action"), opt("goal", "CAST(NULL AS STRING)"), tab.alias("activeTab"),
        context.alias("context"), opt("history", "CAST(array() AS array<string>)"),
        opt("step", "CAST(NULL AS INT)"), opt("timestamp", "CAST(NULL AS TIMESTAMP)"),
    )
    return scans.select(*keys, F.to_json(body).alias("payload"))


def write_payloads(gated: DataFrame, path: str, quarantine: str) -> None:
    """The only way out: payloads that passed go to ``path`` as JSON lines; the verdicts
    of the others, without their payload, go to ``quarantine``.

    The gate is evaluated once: both are written from a table of its verdicts, which holds
    no payload that it blocked."""
    from ..operators.gate import split_gate

    clean = F.when(~F.col("blocked"), F.col("payload"))
    passed, held = split_gate(staged(gated.withColumn("payload", clean), "gated"))
    passed.select("payload").write.mode("overwrite").text(path)
    held.write.mode("overwrite").json(quarantine)


def write_log(log: DataFrame, path: str) -> None:
    """The redaction log, partitioned by category. It has no column for a raw value."""
    columns = [c for c in log.columns if c not in ("selector",)]
    log.select(*columns).write.mode("overwrite").partitionBy("category").parquet(path)


def write_telemetry(steps: DataFrame, path: str) -> None:
    """Append progress records, stamped with the time of writing."""
    steps.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)
