"""Audits of finished payloads: known secrets, expected placeholders, structure, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sanitize import FORM_TAGS
from .search import search

def secret_audit(
    payloads: DataFrame, secrets: DataFrame, key: str, payload: str = "payload", secret: str = "secret"
) -> DataFrame:
    """(key, secret_hash) for every secret that occurs anywhere in a payload, once a row.

    Payloads are read once by an automaton of all secrets, or of each bounded shard of them;
    secrets come from a table, so no plan shows them.
    """
    wanted = secrets.select(F.col(secret).alias("secret")).distinct().select(
        "secret", F.sha2("secret", 256).alias("secret_hash")
    )
    return search(payloads, wanted, key, payload, "secret", "secret_hash")


def leak_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("secret_hash").agg(F.count(F.lit(1)).alias("payloads"))


def placeholder_audit(scans: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """Expected placeholders that a scan's log or texts lack."""
    wanted = F.array(*[F.lit(p) for p in expected])
    logged = F.col("redactions.placeholder")
    shown = F.to_json("elements")
    rows = scans.select(
        key, logged.alias("_log"), shown.alias("_shown"), F.explode(wanted).alias("placeholder")
    ).select(
        key, "placeholder",
        F.array_contains("_log", F.col("placeholder")).alias("in_log"),
        # a number must end there: X_1 is not found in X_12
        F.expr("rlike(_shown, concat('(?<![A-Za-z0-9_])', placeholder, '(?![0-9])'))").alias("in_text"),
    )
    return rows.where(~F.col("in_log") | ~F.col("in_text"))


def structure_audit(scans: DataFrame, key: str, min_elements: int = 11, controls: int = 8) -> DataFrame:
    """One row per scan, one boolean per rule; all true means well formed."""
    form = f"e.tag IN {FORM_TAGS}"
    return scans.selectExpr(
        key,
        r"forall(elements, e -> coalesce(rlike(e.id, r'^el_[0-9]{3}\z'), false)) AS ids_ok",
        "forall(elements, e -> e.selector IS NULL) AS no_selector",
        "forall(elements, e -> NOT (e.tag <=> 'label')) AS no_label_tag",
        f"forall(filter(elements, e -> {form}), e -> coalesce(trim(e.label), '') <> '' "
        "AND e.text IS NULL) AS controls_labelled",
        "size(redactions) = size(array_distinct(transform(redactions, r -> concat_ws('::', r.id, r.category)))) "
        "AS no_duplicates",
        "forall(redactions, r -> forall(filter(elements, e -> e.id <=> r.id), e -> e.sensitive)) AS flagged",
        "NOT exists(elements, e -> e.type <=> 'email' AND exists(redactions, r -> r.id <=> e.id "
        "AND r.category = 'address')) AS no_address_on_email",
        f"(size(elements) >= {min_elements} AND size(filter(elements, e -> {form})) = {controls}) AS complete",
    )


def quality_report(cases: DataFrame) -> DataFrame:
    """``cases``: category, input, output, expect. A case leaks when its input is still
    in the output though it should be gone, and is over-redacted the other way round."""
    kept = F.expr("contains(output, trim(input))")
    outcome = (
        F.when((F.col("expect") == "SHOULD_REDACT") & kept, "leak")
        .when((F.col("expect") == "SHOULD_KEEP") & ~kept, "over_redaction")
        .otherwise("pass")
    )
    return cases.withColumn("outcome", outcome).groupBy("category", "expect", "outcome").agg(
        F.count(F.lit(1)).alias("cases")
    )
