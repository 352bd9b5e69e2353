"""Element, action and OCR tables derived from the star schema.

The given tables hold no forms, action logs or recognised images, so these are
computed from ``customer``, ``orders`` and ``events`` and grow with them. One SQL text
serves both engines: it uses only what Spark and DuckDB share, and ``{fan}`` stands
for the row generator, the one construct they spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sanitize import collect_elements
from ..sources.tables import dealt, table

FORM_ROWS = 17


def _luhn_digit(base: str, digits: int = 15) -> str:
    """SQL for the check digit that completes ``base``."""
    terms = []
    for i in range(1, digits + 1):
        d = f"CAST(substr({base}, {i}, 1) AS INT)"
        terms.append(f"(2*{d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if i % 2 else d)
    return f"((10 - (({' + '.join(terms)}) % 10)) % 10)"


def _fan(n: int, engine: str) -> str:
    return f"explode(sequence(1, {n}))" if engine == "spark" else f"unnest(range(1, {n + 1}))"


def _case(column: str, values: list[str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i + 1} THEN {v}" for i, v in enumerate(values) if v != default)
    return f"CASE {column} {arms} ELSE {default} END"


def form_elements_sql(engine: str, customer: str = "customer") -> str:
    """17 elements per customer: the form's controls, and texts around them."""
    base = f"""
SELECT c_custkey AS k,
  CASE c_custkey % 5 WHEN 0 THEN 'Jane' WHEN 1 THEN 'Omar' WHEN 2 THEN 'Lucia'
    WHEN 3 THEN 'Priya' ELSE 'Tom' END AS first_name,
  CASE c_custkey % 7 WHEN 0 THEN 'Doe' WHEN 1 THEN 'Haddad' WHEN 2 THEN 'Rossi'
    WHEN 3 THEN 'Mehta' WHEN 4 THEN 'Berg' WHEN 5 THEN 'Okoye' ELSE 'Young' END AS last_name,
  '453201' || lpad(CAST(c_custkey AS STRING), 9, '0') AS card15,
  lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS d5,
  lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS d4
FROM {customer}"""
    made = f"""
SELECT k, first_name, last_name, d4, d5,
  lower(first_name) || '.' || lower(last_name) || CAST(k AS STRING) || '@example.com' AS email,
  card15 || CAST({_luhn_digit('card15')} AS STRING) AS card_ok,
  card15 || CAST((({_luhn_digit('card15')}) + 1) % 10 AS STRING) AS card_bad
FROM base"""
    fan = f"SELECT *, {_fan(FORM_ROWS, engine)} AS ord FROM made"
    tag = _case("ord", [
        "'input'", "'input'", "'input'", "'input'", "'textarea'", "'input'", "'input'", "'input'",
        "'h2'", "'p'", "'p'", "'p'", "'div'", "'button'", "'a'", "'p'", "'p'",
    ])
    type_ = _case("ord", [
        "'text'", "'email'", "'tel'", "'password'", "'textarea'", "'text'", "'text'", "'text'",
        "'heading'", "'text block'", "'text block'", "'text block'", "'div'", "'button'",
        "'link'", "'text block'", "'text block'",
    ])
    label = _case("ord", [
        "'Full Name'", "'Email Address'", "'Phone Number'", "'Account Password'",
        "'Residential Address'", "'PAN Card Number'", "'Aadhaar Number'", "'Credit Card'",
    ])
    text = _case("ord", ["NULL"] * 8 + [
        "'Welcome back, ' || upper(email) || '!'",
        "'Reach ' || first_name || ' at 98765' || d5 || ' or (415) 555-' || d4 || '.'",
        "'Order 4567891230 of 12/09/2026, room 204, item 1234567890123456'",
        "'Ship to customer: ' || first_name || ' ' || last_name || ', 12 Park Road, Delhi'",
        "'Note'",
        "CASE WHEN k % 2 = 0 THEN 'Submit Verified Profile' ELSE 'Continue to Step 2' END",
        "'Dr. ' || first_name || ' ' || last_name",
        "'Tax id ABCDE' || d4 || 'F on file, e-mail ' || email || ' or help@example.org'",
        "'one-time code ' || d5",
    ])
    name = _case("ord", [
        "'fullName'", "'email'", "'phone'", "'password'", "'residence'", "'pan'", "'aadhaar'",
        "'cardField'",
    ])
    category = (
        "CASE WHEN ord = 4 THEN 'password' WHEN ord = 8 AND k % 3 = 0 THEN 'payment' ELSE NULL END"
    )
    value = _case("ord", [
        "CASE WHEN k % 6 = 0 THEN lower(first_name) ELSE first_name || ' ' || last_name END",
        "email",
        "'+91 98765 ' || d5",
        "CASE WHEN k % 4 = 0 THEN 'Secret!' || d5 ELSE NULL END",
        "CASE k % 3 WHEN 0 THEN CAST(k % 900 + 1 AS STRING) || ' Tech Park Road, Block B, New Delhi' "
        "WHEN 1 THEN 'Hill  House, ' || last_name ELSE 'c/o ' || email END",
        "'ABCDE' || d4 || 'F'",
        "'2345-6789-' || d4",
        "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN substr(card_ok, 1, 4) || ' ' || substr(card_ok, 5, 4) "
        "|| ' ' || substr(card_ok, 9, 4) || ' ' || substr(card_ok, 13, 4) ELSE card_bad END",
    ] + ["NULL"] * 4 + ["'cc ' || email || ' and card ' || card_ok"])
    ident = (
        "CASE WHEN ord = 16 AND k % 10 < 5 THEN NULL "
        "ELSE 'el_' || lpad(CAST(ord AS STRING), 3, '0') END"
    )
    selector = "CASE WHEN ord = 16 AND k % 10 < 3 THEN '#tax' ELSE NULL END"
    return f"""
WITH base AS ({base}), made AS ({made}), fanned AS ({fan}),
cells AS (
SELECT k AS scan_id, ord, {ident} AS id, {tag} AS tag, {type_} AS type, {label} AS label,
  {text} AS text, {name} AS name, {category} AS category, {value} AS value,
  {selector} AS selector,
  CASE WHEN ord IN (4, 17) THEN TRUE WHEN ord = 8 AND k % 3 = 0 THEN TRUE ELSE FALSE END AS sensitive
FROM fanned)
SELECT *, value IS NOT NULL AS has_value FROM cells"""


def form_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Element rows, one scan per customer."""
    customer = dealt(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    return spark.sql(form_elements_sql("spark", "{customer}"), customer=customer)


def form_scans(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with its elements; 17 elements each."""
    rows = form_elements(spark, folder)
    return collect_elements(rows, ["scan_id"], "ord")
