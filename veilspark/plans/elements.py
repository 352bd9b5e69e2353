"""Queries over element scans: sanitisation, log, gate, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_placeholder, luhn_valid, normalise_key_of, prefix_of
from ..operators.gate import gate, split_gate, violation_rows, violations_by_category
from ..operators.sanitize import log_counts, redaction_log, sanitize_scans, target_of
from . import oracle as o
from .derived import form_elements, form_elements_sql, form_scans


def sanitized(spark: SparkSession, folder: str) -> DataFrame:
    return sanitize_scans(form_scans(spark, folder))


def payloads(scans: DataFrame) -> DataFrame:
    """Outgoing JSON. ``has_value`` and selectors are working columns and stay behind."""
    slim = F.transform(
        "elements",
        lambda e: e.dropFields("has_value", "selector"),
    )
    return scans.select(
        "scan_id", F.to_json(F.struct(slim.alias("elements"))).alias("payload")
    )


def sanitize_elements(spark: SparkSession, folder: str) -> DataFrame:
    return (
        sanitized(spark, folder)
        .select("scan_id", F.posexplode("elements").alias("p", "e"))
        .select(
            "scan_id", (F.col("p") + 1).alias("ord"), "e.text", "e.value", "e.sensitive",
            "e.has_value",
        )
    )


def redaction_log_rows(spark: SparkSession, folder: str) -> DataFrame:
    return redaction_log(sanitized(spark, folder), ["scan_id"]).select(
        "scan_id", "id", "category", "confidence", "source", "placeholder"
    )


def log_count_rows(spark: SparkSession, folder: str) -> DataFrame:
    return log_counts(redaction_log(sanitized(spark, folder), ["scan_id"]), ["scan_id"])


def target_refs(spark: SparkSession, folder: str) -> DataFrame:
    rows = form_elements(spark, folder)
    return rows.groupBy(F.expr(target_of()).alias("target")).agg(
        F.count(F.lit(1)).alias("elements")
    )


def normalise_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Key, prefix and placeholder test of every form value."""
    rows = form_elements(spark, folder).where("value IS NOT NULL")
    category = F.when(F.col("type") == "email", "email").when(
        F.col("type") == "tel", "phone"
    ).when(F.col("name") == "pan", "pan").when(
        F.col("name").isin("aadhaar", "cardField"), "card"
    ).when(F.col("name") == "fullName", "name").otherwise("note")
    return rows.withColumn("cat", category).selectExpr(
        "scan_id", "ord",
        f"{normalise_key_of('cat', 'value')} AS key",
        f"{prefix_of('cat')} AS prefix",
        f"{luhn_valid('value')} AS luhn",
        f"{is_placeholder('concat(upper(cat), chr(95), ord)')} AS placeholder_like",
    )


def gate_raw_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The gate over forms that skipped redaction."""
    return gate(payloads(form_scans(spark, folder))).select(
        "scan_id", "blocked", "violationsCount"
    )


def gate_sanitized_forms(spark: SparkSession, folder: str) -> DataFrame:
    return gate(payloads(sanitized(spark, folder))).select("scan_id", "blocked", "violationsCount")


def raw_form_violations(spark: SparkSession, folder: str) -> DataFrame:
    return violations_by_category(gate(payloads(form_scans(spark, folder))))


def gate_split_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Even scans leave sanitised, odd ones raw; only the former may pass."""
    raw = form_scans(spark, folder).where("scan_id % 2 = 1")
    clean = sanitized(spark, folder).where("scan_id % 2 = 0")
    both = payloads(clean).unionByName(payloads(raw))
    passed, quarantine = split_gate(gate(both))
    return passed.select("scan_id", F.lit("passed").alias("sink")).unionByName(
        quarantine.select("scan_id", F.lit("quarantine").alias("sink"))
    )


def structural_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Violations that carry an element, on raw forms."""
    rows = violation_rows(gate(payloads(form_scans(spark, folder))), ["scan_id"])
    return rows.where("elementId IS NOT NULL").select("scan_id", "category", "elementId", "detail")


_NAME_META = r"(?i)\b(?:full[-_]?name|name)\b"
_ADDR_META = r"(?i)\b(?:address|residence|street)\b"


def _scan_sql() -> tuple[str, str]:
    """CTEs from form elements to folded scans; two texts per element: text, value."""
    meta = "coalesce(label, '') || ' ' || coalesce(name, '') || ' ' || coalesce(selector, '')"
    source = f"""
forms AS MATERIALIZED ({form_elements_sql('duck')}),
flagged AS (SELECT *, tag IN ('input', 'textarea', 'select') AS is_form, {meta} AS meta FROM forms),
parts AS (SELECT scan_id, ord, p,
  CASE WHEN sensitive THEN NULL WHEN p = 1 THEN CASE WHEN is_form THEN NULL ELSE text END
    ELSE value END AS t,
  CASE WHEN p = 1 AND sensitive AND category = 'payment' THEN '#' || ord END AS cp,
  p = 2 AND is_form AND NOT sensitive AND coalesce(length(value), 0) > 0
    AND regexp_matches(meta, '{_NAME_META}') AS nf,
  p = 2 AND is_form AND NOT sensitive AND coalesce(length(value), 0) > 0
    AND regexp_matches(meta, '{_ADDR_META}') AND NOT regexp_matches(meta, '(?i)email') AS af
  FROM flagged, (VALUES (1), (2)) AS v(p)),
grouped AS MATERIALIZED (SELECT scan_id, list(t ORDER BY ord, p) AS texts,
  list(t ORDER BY ord, p) AS orig, list(cp ORDER BY ord, p) AS card_purge,
  list(nf ORDER BY ord, p) AS name_field, list(af ORDER BY ord, p) AS address_field
  FROM parts GROUP BY scan_id)"""
    ctes, last = o.fold_sql("grouped", ["scan_id"], fields=True)
    purges = """
pw AS (SELECT scan_id, ord, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS n
  FROM forms WHERE sensitive AND coalesce(category, '') <> 'payment')"""
    events = " OR ".join(
        f"len(coalesce(k_{c}[2 * ord - 1], [])) + len(coalesce(k_{c}[2 * ord], [])) > 0"
        for c in o.PATTERNS
    )
    final = f"""
done AS MATERIALIZED (SELECT forms.*, texts[2 * ord - 1] AS new_text, texts[2 * ord] AS new_value,
  {events} AS has_event, pw.n AS pw_no,
  CASE WHEN category = 'payment' AND forms.sensitive THEN list_position(dk_card, '#' || ord) END AS card_no,
  {', '.join(f"(list_transform((coalesce(k_{c}[2 * ord - 1], []) || coalesce(k_{c}[2 * ord], [])), lambda q: list_position(dk_{c}, q)))[1] AS first_{c}" for c in o.PATTERNS)}
FROM forms JOIN {last} USING (scan_id) LEFT JOIN pw USING (scan_id, ord))"""
    return f"WITH {source}, {ctes}, {purges}, {final}", "done"


def _sql() -> dict[str, str]:
    with_, _ = _scan_sql()
    forms = form_elements_sql("duck")
    placeholder = (
        "CASE WHEN card_no IS NOT NULL THEN 'CARD_' || card_no ELSE 'PASSWORD_' || pw_no END"
    )
    target = "coalesce(nullif(id, ''), nullif(selector, ''), 'unknown')"
    log = f"""
SELECT scan_id, {target} AS id,
  coalesce(category, CASE WHEN type = 'password' THEN 'password' ELSE 'sensitive' END) AS category,
  1.0::DOUBLE AS confidence, 'dom' AS source, {placeholder} AS placeholder
FROM done WHERE sensitive""" + "".join(
        f"""
UNION ALL SELECT scan_id, {target}, '{c}', {0.7 if c in ('name', 'address') else 1.0}::DOUBLE,
  'dom', '{o.PREFIX[c]}_' || first_{c} FROM done WHERE NOT sensitive AND first_{c} IS NOT NULL"""
        for c in o.PATTERNS
    )
    # gate: leaks counted field by field
    leaf = """
SELECT scan_id, unnest([label, text, name, value]) AS t FROM forms"""
    def text_hits(leaves: str) -> str:
        arms = " UNION ALL ".join(
            f"SELECT scan_id, '{c}' AS category, len(list_filter(regexp_extract_all(t, "
            f"{o.lit(o.PATTERNS[c])}), lambda h: {o.valid_sql(c, 'h')})) AS n FROM ({leaves}) WHERE t IS NOT NULL"
            for c in ("card", "aadhaar", "pan", "phone", "email")
        )
        return f"SELECT scan_id, category, sum(n) AS n FROM ({arms}) GROUP BY ALL HAVING sum(n) > 0"

    credential = "(type = 'password' OR coalesce(category, '') IN ('password', 'payment'))"
    structural = f"""
SELECT scan_id, coalesce(category, CASE WHEN {credential} THEN 'password' ELSE 'sensitive' END) AS category,
  coalesce(nullif(id, ''), 'unknown') AS "elementId",
  CASE WHEN {credential} THEN 'Credential element kept a value.'
    ELSE 'Sensitive element kept a value that is not redacted.' END AS detail
FROM forms WHERE ({credential} AND value IS NOT NULL) OR (sensitive AND value IS NOT NULL)"""
    hits = text_hits(leaf)
    per_scan = f"""
SELECT scan_id, sum(n) AS n FROM (SELECT scan_id, n FROM ({hits})
  UNION ALL SELECT scan_id, count(*) FROM ({structural}) GROUP BY scan_id) GROUP BY scan_id"""
    clean_leaf = """
SELECT scan_id, unnest([label, name,
  CASE WHEN sensitive THEN NULL ELSE coalesce(new_text, text) END, new_value]) AS t FROM done"""
    clean = f"SELECT scan_id, sum(n) AS n FROM ({text_hits(clean_leaf)}) GROUP BY scan_id"
    key_case = " ".join(
        f"WHEN '{c}' THEN {o.key_sql(c, 'value')}" for c in ("email", "phone", "pan", "card")
    )
    return {
        "sanitize_elements": f"""
{with_} SELECT scan_id, ord,
  CASE WHEN sensitive THEN CASE WHEN text IS NOT NULL THEN {placeholder} END
    WHEN tag IN ('input', 'textarea', 'select') THEN text ELSE new_text END AS text,
  CASE WHEN sensitive THEN NULL ELSE new_value END AS value,
  sensitive OR has_event AS sensitive, has_value AND NOT sensitive AS has_value FROM done""",
        "redaction_log": f"{with_} {log}",
        "log_counts": f"{with_} SELECT category, confidence, source, count(*) AS entries, count(DISTINCT scan_id) AS scans FROM ({log}) GROUP BY ALL",
        "target_refs": f"SELECT {target} AS target, count(*) AS elements FROM ({forms}) GROUP BY 1",
        "normalise_keys": f"""
SELECT scan_id, ord, CASE cat {key_case} ELSE {o.key_sql('note', 'value')} END AS key,
  CASE cat WHEN 'email' THEN 'EMAIL' WHEN 'phone' THEN 'PHONE' WHEN 'pan' THEN 'PAN'
    WHEN 'card' THEN 'CARD' WHEN 'name' THEN 'PERSON' ELSE 'NOTE' END AS prefix,
  {o.luhn_sql('value')} AS luhn,
  cat IN ('email', 'phone', 'pan', 'card') AS placeholder_like
FROM (SELECT *, CASE WHEN type = 'email' THEN 'email' WHEN type = 'tel' THEN 'phone'
  WHEN name = 'pan' THEN 'pan' WHEN name IN ('aadhaar', 'cardField') THEN 'card'
  WHEN name = 'fullName' THEN 'name' ELSE 'note' END AS cat FROM ({forms})) WHERE value IS NOT NULL""",
        "gate_raw_forms": f"""
WITH forms AS MATERIALIZED ({forms}) SELECT scan_id, n > 0 AS blocked, CAST(n AS INT) AS "violationsCount"
FROM ({per_scan})""",
        "gate_sanitized_forms": f"""
{with_} SELECT c.c_custkey AS scan_id, coalesce(n, 0) > 0 AS blocked,
  CAST(coalesce(n, 0) AS INT) AS "violationsCount"
FROM customer c LEFT JOIN ({clean}) x ON x.scan_id = c.c_custkey""",
        "violations_by_category": f"""
WITH forms AS MATERIALIZED ({forms}) SELECT category, CAST(sum(n) AS BIGINT) AS violations FROM (
  SELECT category, n FROM ({hits}) UNION ALL SELECT category, 1 FROM ({structural})) GROUP BY 1""",
        "gate_split": """
SELECT c_custkey AS scan_id, CASE WHEN c_custkey % 2 = 0 THEN 'passed' ELSE 'quarantine' END AS sink
FROM customer""",
        "structural_violations": f"WITH forms AS ({forms}) {structural}",
    }


QUERIES = {
    "sanitize_elements": sanitize_elements,
    "redaction_log": redaction_log_rows,
    "log_counts": log_count_rows,
    "target_refs": target_refs,
    "normalise_keys": normalise_keys,
    "gate_raw_forms": gate_raw_forms,
    "gate_sanitized_forms": gate_sanitized_forms,
    "violations_by_category": raw_form_violations,
    "gate_split": gate_split_forms,
    "structural_violations": structural_rows,
}
ORACLE = _sql()
