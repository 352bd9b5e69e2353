"""Queries over pages: extraction, lookup, sanitisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import (
    element_keys,
    element_rows,
    element_states,
    extract_pages,
    lookup_elements,
    map_sizes,
)
from ..operators.actions import validate_actions
from ..operators.gate import gate
from ..operators.sanitize import sanitize_scans
from ..sources.tables import pages, dealt, table
from . import oracle as o
from .elements import payloads


def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    scans = extract_pages(pages(spark, folder))
    return element_rows(scans, ["page_id"]).select(
        "page_id", "ord", "id", "tag", "type", "text", "sensitive"
    )


CAP, CUT = 20, 140  # of the one query that shows the limits


def page_elements_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction for a consumer that takes so many elements and letters, and no more."""
    scans = extract_pages(pages(spark, folder), max_elements=CAP, max_text=CUT)
    return scans.select("page_id", F.col("leftOut").alias("left_out"), F.posexplode("elements").alias("p", "e")).select(
        "page_id", "left_out", "e.id", "e.tag", "e.text"
    )


def page_scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(pages(spark, folder)).select(
        "page_id", "url", "title", F.col("totalElements").alias("total_elements")
    )


def page_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = element_rows(extract_pages(pages(spark, folder)), ["page_id"])
    return rows.groupBy("tag", "type").agg(
        F.count(F.lit(1)).alias("elements"), F.countDistinct("page_id").alias("pages")
    )


def page_selectors(spark: SparkSession, folder: str) -> DataFrame:
    return element_keys(pages(spark, folder), "page_id").select("page_id", "id", "tag", "selector")


WANTED = """
SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM {pages}) AS page_id,
  'el_' || lpad(CAST(o_orderkey % 61 AS STRING), 3, '0') AS id FROM {orders}"""


def element_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Ids asked for by an action log, on all pages of the table, resolved to selectors where
    the page has them."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    read = pages(spark, folder)
    wanted = spark.sql(WANTED, orders=orders, pages=read.select("page_id"))
    return lookup_elements(wanted, element_keys(read, "page_id"), "page_id").select(
        "o_orderkey", "page_id", "id", "tag", "selector"
    )


def element_map_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return map_sizes(pages(spark, folder), "page_id")


# The page when its actions run: on one in three the paragraphs are hidden by a rule, on
# one in three the links by a class that the menu has got.
LATER = """
SELECT page_id, html, CASE page_id % 3
  WHEN 0 THEN '<style>body article > p {{ display: none }}</style>' || html
  WHEN 1 THEN '<style>p {{ display: block }} .shut a {{ visibility: hidden }}</style>' || replace(html, '<nav>', '<nav class="shut">')
  ELSE html END AS later FROM {pages}"""


def page_action_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Nine planned actions a page, checked against the states of the page when they run."""
    read = pages(spark, folder)
    actions = read.select(F.col("page_id").alias("scan_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select(
        "scan_id", "k",
        F.when(F.col("k") % 3 == 2, "TYPE").otherwise("CLICK").alias("action"),
        F.format_string("el_%03d", (F.col("scan_id") * 7 + F.col("k") * 5) % 40 + 1).alias("target"),
        F.lit("x").alias("value"), F.lit(None).cast("string").alias("current_url"),
    )
    states = element_states(spark.sql(LATER, pages=read), "page_id", later="later").withColumnRenamed("page_id", "scan_id")
    return validate_actions(actions, states).select(
        F.col("scan_id").alias("page_id"), "k", "target", "valid",
        F.coalesce(F.startswith("reason", F.lit("hidden target")), F.lit(False)).alias("hidden"),
    )


def sanitize_pages(spark: SparkSession, folder: str) -> DataFrame:
    scans = sanitize_scans(extract_pages(pages(spark, folder)))
    return element_rows(scans, ["page_id"]).select("page_id", "ord", "text", "sensitive")


def page_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Page to gate: extracted, sanitised, serialised, checked."""
    scans = sanitize_scans(extract_pages(pages(spark, folder))).withColumnRenamed(
        "page_id", "scan_id"
    )
    return gate(payloads(scans)).select(
        F.col("scan_id").alias("page_id"), "blocked", "violationsCount"
    )


# A form page per customer, so that controls, labels and images occur in markup too.
FORM_PAGE = """
SELECT c_custkey AS page_id, 'http://form.example.com/' || CAST(c_custkey AS STRING) AS url,
  '<!doctype html><html><head><title>Profile</title></head><body><h1>Your profile</h1><form>'
  || '<label for="n">Full  Name</label><input id="n" name="fullName" value="Jane Doe">'
  || '<label>Mail <input type="email" name="mail" value="user' || CAST(c_custkey AS STRING)
  || '@example.com"></label>'
  || '<input type="password" placeholder="Password" value="s3cret">'
  || '<input autocomplete="cc-number" aria-label="Card" value="4111111111111111">'
  || '<select name="seg"><option value="' || c_mktsegment || '" selected>'
  || lower(c_mktsegment) || '</option></select>'
  || '<input type="checkbox" title="Agree">'
  || CASE WHEN c_custkey % 2 = 0 THEN '<p hidden>not shown</p>' ELSE '<p>shown &amp; read</p>' END
  || '<div style="display: none"><button>gone</button></div>'
  || '<canvas></canvas><img alt="Company Logo"><img alt="passport scan"><img>'
  || '<input type="submit" value="Send"></form></body></html>' AS html
FROM {customer}"""


def form_page_elements(spark: SparkSession, folder: str) -> DataFrame:
    customer = dealt(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"))
    scans = extract_pages(spark.sql(FORM_PAGE, customer=customer))
    return element_rows(scans, ["page_id"]).select(
        "page_id", "ord", "id", "tag", "type", "label", "text", "name", "category", "value",
        "sensitive", "alt", F.col("visionTriggered").alias("vision"),
    )


def _elements_sql() -> str:
    """The given pages have one shape: a nav list, then a headline and paragraphs."""
    # an entity cut off at the end of a page still counts without its semicolon
    unescape = (
        "regexp_replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), "
        "'&quot;', '\"'), '&#x27;', ''''), '&amp;?', '&', 'g')"
    )
    p_text = o.strip_sql(o.collapse_sql(unescape.format(
        x="regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
    )))
    flat = lambda x: o.strip_sql(o.collapse_sql(unescape.format(x=x)))
    return f"""
raw AS (SELECT page_id, url, html,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS links,
  regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
  string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>')[2:] AS ps FROM pages),
cells AS (
SELECT page_id, 1 AS band, i AS nth, 'a' AS tag, 'link' AS type, {flat('links[i]')} AS text, hrefs[i] AS href
  FROM raw, unnest(range(1, len(links) + 1)) AS u(i)
UNION ALL SELECT page_id, 2, 1, 'h1', 'heading', {flat('h1')}, NULL FROM raw
UNION ALL SELECT page_id, 3, i, 'li', 'text block', {flat('links[i]')}, NULL
  FROM raw, unnest(range(1, len(links) + 1)) AS u(i)
UNION ALL SELECT page_id, 4, i, 'p', 'text block', {p_text}, NULL FROM (
  SELECT page_id, i, split_part(ps[i], '</p>', 1) AS x FROM raw, unnest(range(1, len(ps) + 1)) AS u(i))),
cut AS (SELECT page_id, band, nth, tag, type, href, text FROM cells),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY band, nth) AS ord FROM cut
  WHERE NOT (tag IN ('p', 'li') AND length(text) < 2)),
elements AS MATERIALIZED (SELECT *, format('el_{{:03d}}', ord) AS id
  FROM kept)"""


def _sql() -> dict[str, str]:
    elements = _elements_sql()
    step = "CASE WHEN nth > 1 THEN ':nth-of-type(' || nth || ')' ELSE '' END"
    keys = f"""
hrefs AS (SELECT page_id, href, count(*) AS n FROM cells WHERE tag = 'a' GROUP BY ALL),
keys AS (SELECT e.page_id, e.id, e.tag, CASE tag
  WHEN 'a' THEN CASE WHEN n = 1 AND length(e.href) < 80 THEN 'a[href="' || e.href || '"]'
    ELSE 'body > nav > ul > li' || {step} || ' > a' END
  WHEN 'h1' THEN 'body > article > h1'
  WHEN 'li' THEN 'body > nav > ul > li' || {step}
  ELSE 'body > article > p' || {step} END AS selector
  FROM elements e LEFT JOIN hrefs USING (page_id, href))"""
    ctes, last = o.fold_sql("grouped", ["page_id", "ords"])
    folded = f"""
WITH {elements}, grouped AS (SELECT page_id, list(ord ORDER BY ord) AS ords,
  list(text ORDER BY ord) AS texts FROM elements GROUP BY page_id), {ctes}"""
    any_key = " + ".join(f"len(k_{c}[i])" for c in o.PATTERNS)
    left = " + ".join(
        f"len(list_filter(regexp_extract_all(t, {o.lit(o.PATTERNS[c])}), lambda h: {o.valid_sql(c, 'h')}))"
        for c in ("card", "aadhaar", "pan", "phone", "email")
    )
    rows = [
        ("input", "text", "'Full Name'", "NULL", "'fullName'", "NULL", "'Jane Doe'", "FALSE"),
        ("input", "email", "'Mail'", "NULL", "'mail'", "NULL", "'user' || c_custkey || '@example.com'", "FALSE"),
        ("input", "password", "'Password'", "NULL", "NULL", "'password'", "NULL", "TRUE"),
        ("input", "text", "'Card'", "NULL", "NULL", "'payment'", "NULL", "TRUE"),
        ("select", "select", "lower(c_mktsegment)", "NULL", "'seg'", "NULL", "c_mktsegment", "FALSE"),
        ("input", "checkbox", "'Agree'", "NULL", "NULL", "NULL", "'on'", "FALSE"),
        ("input", "submit", "NULL", "'Send'", "NULL", "NULL", "NULL", "FALSE"),
        ("h1", "heading", "NULL", "'Your profile'", "NULL", "NULL", "NULL", "FALSE"),
        ("p", "text block", "NULL", "'shown & read'", "NULL", "NULL", "NULL", "FALSE"),
        ("canvas", "canvas", "NULL", "''", "NULL", "NULL", "NULL", "FALSE", "NULL", "TRUE"),
        ("img", "image", "NULL", "''", "NULL", "NULL", "NULL", "FALSE", "'Company Logo'", "FALSE"),
        ("img", "image", "NULL", "''", "NULL", "NULL", "NULL", "FALSE", "'passport scan'", "TRUE"),
        ("img", "image", "NULL", "''", "NULL", "NULL", "NULL", "FALSE", "''", "TRUE"),
    ]
    form = " UNION ALL ".join(
        f"SELECT c_custkey AS page_id, {i} AS k, '{r[0]}' AS tag, '{r[1]}' AS type, {r[2]} AS label, "
        f"{r[3]} AS text, {r[4]} AS name, {r[5]} AS category, {r[6]} AS value, {r[7]} AS sensitive, "
        f"{r[8] if len(r) > 8 else 'NULL'} AS alt, {r[9] if len(r) > 8 else 'NULL'} AS vision FROM customer"
        + (" WHERE c_custkey % 2 = 1" if r[0] == "p" else "")
        for i, r in enumerate(rows)
    )
    return {
        "page_elements_capped": f"""WITH {elements}
SELECT page_id, CAST(greatest(n - {CAP}, 0) AS INT) AS left_out, id, tag, substr(text, 1, {CUT}) AS text
FROM elements JOIN (SELECT page_id, count(*) AS n FROM elements GROUP BY 1) USING (page_id) WHERE ord <= {CAP}""",
        "page_elements": f"WITH {elements} SELECT page_id, ord, id, tag, type, text, FALSE AS sensitive FROM elements",
        "page_scan_summary": f"""
WITH {elements} SELECT page_id, url, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title,
  (SELECT CAST(count(*) AS INT) FROM elements e WHERE e.page_id = raw.page_id) AS total_elements FROM raw""",
        "page_type_counts": f"""
WITH {elements} SELECT tag, type, count(*) AS elements, count(DISTINCT page_id) AS pages
FROM elements GROUP BY ALL""",
        "page_selectors": f"WITH {elements}, {keys} SELECT * FROM keys",
        "element_lookup": f"""
WITH {elements}, {keys}, wanted AS ({WANTED.format(orders='orders', pages='pages')})
SELECT o_orderkey, page_id, id, tag, selector FROM wanted LEFT JOIN keys USING (page_id, id)""",
        "element_lookup_all": f"""
WITH {elements}, {keys}, wanted AS ({WANTED.format(orders='orders', pages='pages')})
SELECT o_orderkey, page_id, id, tag, selector FROM wanted LEFT JOIN keys USING (page_id, id)""",
        "page_action_audit": f"""WITH {elements},
actions AS (SELECT page_id, k, k % 3 = 2 AS types, format('el_{{:03d}}', (page_id * 7 + k * 5) % 40 + 1) AS target
  FROM pages, unnest(range(0, 9)) AS u(k))
SELECT a.page_id, CAST(k AS INT) AS k, target, coalesce(NOT types AND tag = 'a' AND a.page_id % 3 <> 1, FALSE) AS valid,
  coalesce((tag = 'p' AND a.page_id % 3 = 0) OR (tag = 'a' AND a.page_id % 3 = 1), FALSE) AS hidden
FROM actions a LEFT JOIN elements e ON e.page_id = a.page_id AND e.id = a.target""",
        "element_map_sizes": f"WITH {elements} SELECT page_id, count(*) AS size FROM elements GROUP BY ALL",
        "sanitize_pages": f"""
{folded} SELECT page_id, ords[i] AS ord, texts[i] AS text, {any_key} > 0 AS sensitive
FROM {last}, unnest(range(1, len(ords) + 1)) AS u(i)""",
        "page_verdicts": f"""
{folded}, left_over AS (SELECT page_id, sum({left}) AS n
  FROM (SELECT page_id, unnest(texts) AS t FROM {last}) GROUP BY page_id)
SELECT page_id, n > 0 AS blocked, CAST(n AS INT) AS "violationsCount" FROM left_over""",
        "form_page_elements": f"""
SELECT * EXCLUDE (k), 'el_' || lpad(CAST(ord AS VARCHAR), 3, '0') AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS ord FROM ({form}))""",
    }


QUERIES = {
    "page_elements": page_elements,
    "page_elements_capped": page_elements_capped,
    "page_scan_summary": page_scan_summary,
    "page_type_counts": page_type_counts,
    "page_selectors": page_selectors,
    "element_lookup": element_lookup,
    "element_lookup_all": element_lookup,
    "element_map_sizes": element_map_sizes,
    "page_action_audit": page_action_audit,
    "sanitize_pages": sanitize_pages,
    "page_verdicts": page_verdicts,
    "form_page_elements": form_page_elements,
}
ORACLE = _sql()
