"""Audit queries over form scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audits import (
    leak_counts,
    placeholder_audit,
    quality_report,
    secret_audit,
    structure_audit,
)
from ..operators.redact import redact_rows
from ..operators.sanitize import sanitize_scans
from ..sources.payloads import outgoing_payloads, payload_scans
from . import oracle as o
from .derived import form_elements, form_elements_sql, form_scans
from .elements import _scan_sql, payloads, sanitized

EXPECTED = ("PERSON_1", "EMAIL_1", "PHONE_1", "PASSWORD_1", "ADDRESS_1", "PAN_1", "AADHAAR_1", "CARD_1")


def known_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw value of the forms, whatever its kind."""
    return form_elements(spark, folder).where("value IS NOT NULL").select(F.col("value").alias("secret"))


def secret_audit_raw(spark: SparkSession, folder: str) -> DataFrame:
    """How many raw payloads hold each raw form value."""
    raw = payloads(form_scans(spark, folder))
    return leak_counts(secret_audit(raw, known_secrets(spark, folder), "scan_id"))


def secret_audit_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The same over sanitised payloads: what comes out is in texts that are no personal data."""
    clean = payloads(sanitized(spark, folder))
    return leak_counts(secret_audit(clean, known_secrets(spark, folder), "scan_id"))


def secret_audit_planted(spark: SparkSession, folder: str) -> DataFrame:
    """The same over sanitised payloads, with all raw values of one form in seven put back."""
    leaks = form_elements(spark, folder).where("scan_id % 7 = 3 AND value IS NOT NULL").groupBy("scan_id").agg(
        F.concat_ws("|", F.collect_list("value")).alias("leak")
    )
    clean = payloads(sanitized(spark, folder)).join(leaks, "scan_id", "left").withColumn(
        "payload", F.concat_ws("|", "payload", "leak")
    )
    return leak_counts(secret_audit(clean, known_secrets(spark, folder), "scan_id"))


def placeholder_audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return placeholder_audit(sanitized(spark, folder), "scan_id", list(EXPECTED)).select(
        "scan_id", "placeholder", "in_log"
    )


def structure_audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return structure_audit(sanitized(spark, folder), "scan_id")


def quality_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Each form value and text as a case: controls hold personal data, row 11 does not."""
    rows = form_elements(spark, folder).where("NOT sensitive").select(
        "ord", F.coalesce("value", "text").alias("input")
    ).where("input IS NOT NULL AND ord IN (2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 15)")
    cases = rows.withColumn("text", F.col("input"))
    return redact_rows(cases).select(
        F.format_string("row %d", "ord").alias("category"), "input", F.col("text").alias("output"),
        F.when(F.col("ord") == 11, "SHOULD_KEEP").otherwise("SHOULD_REDACT").alias("expect"),
    )


def quality_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(quality_cases(spark, folder))


def payload_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Scan to outgoing JSON and back: what a receiver can read from a payload."""
    back = payload_scans(outgoing_payloads(sanitize_scans(form_scans(spark, folder)), ["scan_id"]))
    return back.select("scan_id", F.posexplode("elements").alias("p", "e")).select(
        "scan_id", (F.col("p") + 1).alias("ord"), "e.has_value", "e.sensitive",
        F.col("e.selector").isNull().alias("no_selector"),
    )


def _sql() -> dict[str, str]:
    with_, _ = _scan_sql()
    forms = form_elements_sql("duck")
    case_text = "coalesce(value, text)"
    changed = " OR ".join(
        f"len(list_filter({o.matches_sql(c, 'input')}, lambda h: {o.valid_sql(c, 'h.raw')})) > 0"
        for c in o.PATTERNS
    )
    first_any = {
        "PERSON_1": "first_name IS NOT NULL", "EMAIL_1": "first_email IS NOT NULL",
        "PHONE_1": "first_phone IS NOT NULL", "ADDRESS_1": "first_address IS NOT NULL",
        "PAN_1": "first_pan IS NOT NULL", "AADHAAR_1": "first_aadhaar IS NOT NULL",
        "CARD_1": "first_card IS NOT NULL OR card_no IS NOT NULL", "PASSWORD_1": "pw_no IS NOT NULL",
    }
    shown = (
        "coalesce(CASE WHEN sensitive THEN CASE WHEN text IS NOT NULL THEN 'PASSWORD_' || pw_no END "
        "WHEN tag IN ('input', 'textarea', 'select') THEN text ELSE new_text END, '') || '|' || "
        "coalesce(CASE WHEN NOT sensitive THEN new_value END, '')"
    )
    audit = " UNION ALL ".join(
        f"SELECT scan_id, '{p}' AS placeholder, bool_or({test}) AS in_log, "
        f"bool_or(regexp_matches({shown}, '\\b{p}([^0-9]|$)')) AS in_text FROM done GROUP BY scan_id"
        for p, test in first_any.items()
    )
    secrets = "secrets AS (SELECT DISTINCT value AS s FROM raw WHERE value IS NOT NULL)"
    counted = "SELECT sha256(s) AS secret_hash, count(*) AS payloads FROM secrets JOIN bodies ON contains(body, s) GROUP BY 1"
    raw_audit = f"""
WITH raw AS MATERIALIZED ({forms}),
bodies AS (SELECT scan_id, string_agg(concat_ws('|', label, text, name, value), '|') AS body FROM raw GROUP BY 1),
{secrets} {counted}"""
    shown_audit = f"""
{with_}, raw AS MATERIALIZED ({forms}),
shown_parts AS (SELECT scan_id, concat_ws('|', label, {shown}, name) AS part FROM done {{planted}}),
bodies AS (SELECT scan_id, string_agg(part, '|') AS body FROM shown_parts GROUP BY 1),
{secrets} {counted}"""
    return {
        "secret_audit": raw_audit,
        "secret_audit_all": raw_audit,
        "secret_audit_clean": shown_audit.replace("{planted}", ""),
        "secret_audit_planted": shown_audit.replace(
            "{planted}", "UNION ALL SELECT scan_id, value FROM raw WHERE scan_id % 7 = 3 AND value IS NOT NULL"
        ),
        "placeholder_audit": f"""
{with_} SELECT scan_id, placeholder, in_log FROM ({audit}) WHERE NOT in_log OR NOT in_text""",
        "structure_audit": """
SELECT c_custkey AS scan_id, c_custkey % 10 >= 5 AS ids_ok, c_custkey % 10 >= 3 AS no_selector, TRUE AS no_label_tag,
  TRUE AS controls_labelled, TRUE AS no_duplicates, TRUE AS flagged, TRUE AS no_address_on_email, TRUE AS complete
FROM customer""",
        "quality_report": f"""
WITH cases AS (SELECT 'row ' || ord AS category, {case_text} AS input,
  CASE WHEN ord = 11 THEN 'SHOULD_KEEP' ELSE 'SHOULD_REDACT' END AS expect FROM ({forms})
  WHERE NOT sensitive AND {case_text} IS NOT NULL AND ord IN (2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 15)),
marked AS (SELECT *, {changed} AS hit FROM cases)
SELECT category, expect, CASE WHEN expect = 'SHOULD_REDACT' AND NOT hit THEN 'leak'
  WHEN expect = 'SHOULD_KEEP' AND hit THEN 'over_redaction' ELSE 'pass' END AS outcome, count(*) AS cases
FROM marked GROUP BY 1, 2, 3""",
        "payload_round_trip": f"""
{with_} SELECT scan_id, ord, has_value AND NOT sensitive AS has_value, sensitive OR has_event AS sensitive,
  TRUE AS no_selector FROM done""",
    }


QUERIES = {
    "secret_audit": secret_audit_raw,
    "secret_audit_clean": secret_audit_clean,
    "secret_audit_all": secret_audit_raw,
    "secret_audit_planted": secret_audit_planted,
    "placeholder_audit": placeholder_audit_rows,
    "structure_audit": structure_audit_rows,
    "quality_report": quality_report_rows,
    "payload_round_trip": payload_round_trip,
}
ORACLE = _sql()
