"""Queries over recognised image text, derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vision import DECORATIVE_TOKENS, trigger
from ..operators.extract import extract_pages, visual_candidates
from ..operators.sanitize import redaction_log, sanitize_scans
from ..operators.vision import (
    applied_counts,
    blackout_rectangles,
    detect_visual,
    flatten_ocr,
    merge_vision,
    ocr_line_rows,
)
from ..sources.tables import dealt, table
from .pages import FORM_PAGE

TRIGGER_INPUT = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'canvas' WHEN 1 THEN 'input' ELSE 'IMG' END AS tag,
  CASE o_orderkey % 11 WHEN 0 THEN 'Government ID  card proof' WHEN 1 THEN 'Company Logo' WHEN 2 THEN ''
    WHEN 3 THEN 'scan of pan-card' WHEN 4 THEN 'identity badge' WHEN 5 THEN 'holiday' WHEN 6 THEN NULL
    WHEN 7 THEN 'bank_statement.png' WHEN 8 THEN 'documents' WHEN 9 THEN 'KYC' ELSE ' ' END AS alt,
  CASE o_orderkey % 7 WHEN 0 THEN 'presentation' WHEN 1 THEN 'img' ELSE NULL END AS role,
  CASE o_orderkey % 3 WHEN 0 THEN 'Avatar-small' ELSE NULL END AS class_name,
  o_orderkey % 2 = 0 AS is_form FROM {orders}"""


def vision_trigger(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql(TRIGGER_INPUT, orders=table(spark, folder, "orders").select("o_orderkey"))
    decision = trigger(
        "tag", "CAST(NULL AS STRING)", alt="alt", class_name="class_name", role="role", is_form="is_form"
    )
    return rows.select("o_orderkey", F.expr(decision).alias("d")).select(
        "o_orderkey", F.col("d.trigger").alias("on"), F.col("d.reason").alias("reason"),
        F.col("d.categoryHint").alias("hint"),
    )


def _line(text: str, confidence: str, box: str, words: str) -> str:
    return f'{{"text":"{text}","confidence":{confidence},"bbox":{box},"words":[{words}]}}'


def _bbox(x0: int, y0: int, x1: int, y1: int) -> str:
    return f'{{"x0":{x0},"y0":{y0},"x1":{x1},"y1":{y1}}}'


def _ocr_sql(fan: str) -> str:
    """Three images per form page: the canvas, the scan, the unlabelled picture."""
    canvas = (
        '{"text":"","confidence":88.5,"blocks":[{"paragraphs":[{"lines":['
        + _line(" Aadhaar 2345 6789 #4 ", "91.6", _bbox(10, 20, 330, 42),
                '{"text":"Aadhaar","confidence":90.2,"bbox":' + _bbox(10, 20, 90, 42) + '},'
                '{"text":"2345","confidence":90.2,"bbox":' + _bbox(100, 20, 150, 42) + "}")
        + ',{"text":"   ","confidence":1.0},'
        + _line("user#k@example.com", "0", _bbox(3, 1, 283, 9), "")
        + ']},{"lines":['
        + _line("Call +91 98765 #5", "79.5", _bbox(5, 5, 1, 30), '{"text":"98765","bbox":' + _bbox(2, 1, 30, 12) + "}")
        + "]}]}]}"
    )
    scan = (
        '{"text":"Card","blocks":[{"paragraphs":[{"lines":['
        + _line("Card 4532 0151 1283 0366", "95", _bbox(0, 0, 200, 20), "") + ","
        + _line("Mr. Jane Roe Doe", "64.49", _bbox(0, 30, 120, 50), "") + "]}]}]}"
    )
    picture = '{"text":" Tax ABCDE#4F ","confidence":66.4}'

    def filled(template: str) -> str:
        return (
            f"replace(replace(replace('{template}', '#4', d4), '#5', d5), '#k', CAST(k AS STRING))"
        )

    return f"""
SELECT k AS page_id, 'el_' || lpad(CAST(first_el + CASE pic WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 3 END AS STRING), 3, '0') AS element_id,
  CASE pic WHEN 1 THEN TRUE WHEN 2 THEN k % 3 <> 0 ELSE TRUE END AS success,
  CASE pic WHEN 1 THEN {filled(canvas)} WHEN 2 THEN {filled(scan)} ELSE {filled(picture)} END AS ocr
FROM (SELECT c_custkey AS k, 9 + c_custkey % 2 AS first_el, {fan} AS pic,
  lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS d4, lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS d5
  FROM {{customer}}) AS t WHERE NOT (pic = 3 AND k % 5 = 0)"""


def ocr_results(spark: SparkSession, folder: str) -> DataFrame:
    customer = dealt(table(spark, folder, "customer").select("c_custkey"))
    customer.createOrReplaceTempView("veil_customer")
    return spark.sql(_ocr_sql("explode(sequence(1, 3))").replace("{customer}", "veil_customer"))


def ocr_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = ocr_line_rows(flatten_ocr(ocr_results(spark, folder)), ["page_id", "element_id"])
    return rows.select(
        "page_id", "element_id", "line_ord", "text", "confidence", "boundingBox.x", "boundingBox.y",
        "boundingBox.width", "boundingBox.height", F.size("words").alias("n_words"),
    )


def ocr_pages(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_ocr(ocr_results(spark, folder)).select(
        "page_id", "element_id", F.col("rawText").alias("raw_text"),
        F.col("ocrConfidence").alias("confidence"),
    )


def instructions(spark: SparkSession, folder: str) -> DataFrame:
    found = detect_visual(flatten_ocr(ocr_results(spark, folder)))
    return found.select("page_id", "element_id", F.posexplode("instructions").alias("no", "i")).select(
        "page_id", "element_id", "no", "i.line", "i.category", "i.confidence", "i.boundingBox"
    )


def visual_pii(spark: SparkSession, folder: str) -> DataFrame:
    return instructions(spark, folder).select(
        "page_id", "element_id", "no", "line", "category", "confidence", "boundingBox.x", "boundingBox.width"
    )


def blackout_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return blackout_rectangles(instructions(spark, folder)).select(
        "page_id", "element_id", "no", "rect_x", "rect_y", "rect_width", "rect_height", "labelled"
    )


def blackout_counts(spark: SparkSession, folder: str) -> DataFrame:
    return applied_counts(blackout_rectangles(instructions(spark, folder)), ["page_id", "element_id"])


def merged(spark: SparkSession, folder: str) -> DataFrame:
    customer = dealt(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"))
    pages = spark.sql(FORM_PAGE, customer=customer)
    scans = sanitize_scans(extract_pages(pages), keep_registry=True)
    results = detect_visual(flatten_ocr(ocr_results(spark, folder)))
    return merge_vision(scans, visual_candidates(pages, "page_id"), results, "page_id")


def merged_log(spark: SparkSession, folder: str) -> DataFrame:
    return redaction_log(merged(spark, folder), ["page_id"]).drop("log_no")


def vision_flags(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark, folder).select("page_id", F.explode("elements").alias("e")).select(
        "page_id", "e.id", "e.sensitive",
        F.coalesce("e.visualScanFailed", F.lit(False)).alias("failed"),
    )


def _sql() -> dict[str, str]:
    decorative = " OR ".join(f"ctx LIKE '%{t}%'" for t in DECORATIVE_TOKENS)
    keyword = (
        r"\b(id[\s_-]+card|identity|license|driving[\s_-]+license|passport|aadhaar|pan[\s_-]+card|document|"
        r"screenshot|cheque|passbook|bank[\s_-]+statement|tax[\s_-]+id|ssn|kyc|verification[\s_-]+doc|id[\s_-]+proof)\b"
    )
    pics = f"""
ids AS (SELECT c_custkey AS page_id, c_custkey AS k, 'el_' || lpad(CAST(9 + c_custkey % 2 AS VARCHAR), 3, '0') AS canvas,
  'el_' || lpad(CAST(11 + c_custkey % 2 AS VARCHAR), 3, '0') AS scan,
  'el_' || lpad(CAST(12 + c_custkey % 2 AS VARCHAR), 3, '0') AS picture,
  lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS d4, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS d5 FROM customer)"""
    lines = [
        ("canvas", 0, "'Aadhaar 2345 6789 ' || d4", 92, 10, 20, 320, 22, 2, ""),
        ("canvas", 1, "'user' || k || '@example.com'", 89, 3, 1, 280, 8, 0, ""),
        ("canvas", 2, "'Call +91 98765 ' || d5", 80, 5, 5, 0, 25, 1, ""),
        ("scan", 0, "'Card 4532 0151 1283 0366'", 95, 0, 0, 200, 20, 0, ""),
        ("scan", 1, "'Mr. Jane Roe Doe'", 64, 0, 30, 120, 20, 0, ""),
        ("picture", 0, "'Tax ABCDE' || d4 || 'F'", 66, 0, 0, 100, 40, 0, " WHERE k % 5 <> 0"),
    ]
    line_sql = " UNION ALL ".join(
        f"SELECT page_id, {e} AS element_id, {n} AS line_ord, {t} AS text, {c} AS confidence, {x} AS x, {y} AS y, "
        f"{w} AS width, {h} AS height, {k} AS n_words FROM ids{cond}"
        for e, n, t, c, x, y, w, h, k, cond in lines
    )
    hits = [
        ("canvas", 0, 0, "aadhaar", 1.0, 100, 20, 50, 22, ""),
        ("canvas", 1, 1, "email", 1.0, 3, 1, 280, 8, ""),
        ("canvas", 2, 2, "phone", 1.0, 2, 1, 28, 11, ""),
        ("scan", 0, 0, "card", 1.0, 0, 0, 200, 20, ""),
        ("scan", 1, 0, "aadhaar", 1.0, 0, 0, 200, 20, ""),
        ("scan", 2, 1, "name", 0.7, 0, 30, 120, 20, ""),
        ("picture", 0, 0, "pan", 1.0, 0, 0, 100, 40, " WHERE k % 5 <> 0"),
    ]
    hit_sql = " UNION ALL ".join(
        f"SELECT page_id, {e} AS element_id, {no} AS no, {ln} AS line, '{c}' AS category, "
        f"{conf}::DOUBLE AS confidence, {x} AS x, {y} AS y, {w} AS width, {h} AS height FROM ids{cond}"
        for e, no, ln, c, conf, x, y, w, h, cond in hits
    )
    log = [
        ("'el_001'", "name", 0.7, "dom", "PERSON_1", ""), ("'el_002'", "email", 1.0, "dom", "EMAIL_1", ""),
        ("'el_003'", "password", 1.0, "dom", "PASSWORD_1", ""), ("'el_004'", "payment", 1.0, "dom", "CARD_1", ""),
        ("canvas", "aadhaar", 1.0, "vision", "AADHAAR_1", ""), ("canvas", "email", 1.0, "vision", "EMAIL_1", ""),
        ("canvas", "phone", 1.0, "vision", "PHONE_1", ""),
        ("scan", "card", 1.0, "vision", "CARD_2", " WHERE k % 3 <> 0"),
        ("scan", "aadhaar", 1.0, "vision", "AADHAAR_2", " WHERE k % 3 <> 0"),
        ("scan", "name", 0.7, "vision", "PERSON_2", " WHERE k % 3 <> 0"),
        ("picture", "pan", 1.0, "vision", "PAN_1", " WHERE k % 5 <> 0"),
    ]
    log_sql = " UNION ALL ".join(
        f"SELECT page_id, {e} AS id, '{c}' AS category, {conf}::DOUBLE AS confidence, '{s}' AS source, "
        f"'{p}' AS placeholder FROM ids{cond}"
        for e, c, conf, s, p, cond in log
    )
    return {
        "vision_trigger": f"""
WITH t AS ({TRIGGER_INPUT.format(orders='orders')}),
c AS (SELECT *, lower(concat_ws(' ', coalesce(trim(alt), ''), '', '', '', coalesce(class_name, ''))) AS ctx FROM t),
m AS (SELECT *, coalesce(regexp_extract(ctx, '{keyword}', 0), '') AS kw FROM c),
d AS (SELECT *, CASE WHEN tag = 'canvas' THEN 1 WHEN tag <> 'IMG' THEN 2 WHEN role = 'presentation' THEN 3
  WHEN kw <> '' THEN 4 WHEN {decorative} THEN 5 WHEN coalesce(trim(alt), '') = '' AND is_form THEN 6 ELSE 7 END AS k FROM m)
SELECT o_orderkey, k IN (1, 4, 6) AS "on", CASE k WHEN 1 THEN 'canvas' WHEN 2 THEN 'explained by its text: ' || tag
  WHEN 3 THEN 'decorative by role' WHEN 4 THEN 'keyword: ' || kw
  WHEN 5 THEN 'decorative: ' || coalesce(nullif(trim(coalesce(alt, '')), ''), lower(class_name))
  WHEN 6 THEN 'unlabeled image on a form page' ELSE 'no match: ' || coalesce(nullif(trim(alt), ''), 'none') END AS reason,
  CASE k WHEN 1 THEN 'canvas_document' WHEN 4 THEN 'id_document' WHEN 6 THEN 'unlabeled_image' END AS hint FROM d""",
        "ocr_lines": f"WITH {pics} {line_sql}",
        "ocr_pages": f"""
WITH {pics} SELECT page_id, canvas AS element_id, 'Aadhaar 2345 6789 ' || d4 || chr(10) || 'user' || k || '@example.com'
  || chr(10) || 'Call +91 98765 ' || d5 AS raw_text, 89 AS confidence FROM ids
UNION ALL SELECT page_id, scan, 'Card', 95 FROM ids
UNION ALL SELECT page_id, picture, ' Tax ABCDE' || d4 || 'F ', 66 FROM ids WHERE k % 5 <> 0""",
        "visual_pii": f"WITH {pics} SELECT * EXCLUDE (y, height) FROM ({hit_sql})",
        "blackout_boxes": f"""
WITH {pics} SELECT page_id, element_id, no, greatest(0, x - 4) AS rect_x, greatest(0, y - 2) AS rect_y,
  width + 8 AS rect_width, height + 4 AS rect_height, height + 4 >= 14 AND width + 8 >= 40 AS labelled FROM ({hit_sql})""",
        "blackout_counts": f"""
WITH {pics} SELECT page_id, element_id, count(*) AS applied_count FROM ({hit_sql}) GROUP BY 1, 2""",
        "merged_log": f"WITH {pics} {log_sql}",
        "vision_flags": f"""
WITH {pics}, n AS (SELECT *, unnest(range(1, 13 + k % 2)) AS i FROM ids),
e AS (SELECT *, 'el_' || lpad(CAST(i AS VARCHAR), 3, '0') AS id FROM n)
SELECT page_id, id, i <= 4 OR id = canvas OR (id = scan AND k % 3 <> 0) OR (id = picture AND k % 5 <> 0) AS sensitive,
  (id = scan AND k % 3 = 0) OR (id = picture AND k % 5 = 0) AS failed FROM e""",
    }


QUERIES = {
    "vision_trigger": vision_trigger,
    "ocr_lines": ocr_lines,
    "ocr_pages": ocr_pages,
    "visual_pii": visual_pii,
    "blackout_boxes": blackout_boxes,
    "blackout_counts": blackout_counts,
    "merged_log": merged_log,
    "vision_flags": vision_flags,
}
ORACLE = _sql()
