"""Queries over documents and conversations: detection, redaction, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import candidates, match_positions, matches
from ..functions.rules import GATE_CATEGORIES, RULES
from ..operators.gate import gate, split_gate, violation_rows
from ..operators.redact import redact_rows, redact_scans
from ..sources.tables import conversations, documents, dealt, spread, table
from . import oracle as o

BY_CATEGORY = {r.category: r for r in RULES}


def redact_documents(spark: SparkSession, folder: str) -> DataFrame:
    return redact_rows(documents(spark, folder)).select(
        "doc_id", "text", F.size("events").alias("n_events")
    )


def _rule_query(category: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rule = BY_CATEGORY[category]
        return (
            documents(spark, folder)
            .select(
                "doc_id",
                F.expr(f"size({candidates('text', rule)})").alias("n_candidates"),
                F.expr(f"size({matches('text', rule)})").alias("n_matches"),
            )
            .where("n_candidates > 0")
        )

    return query


def _rule_sql(category: str) -> str:
    m = o.matches_sql(category, "text")
    return f"""
SELECT doc_id, len(m) AS n_candidates,
  len(list_filter(m, lambda h: {o.valid_sql(category, 'h.raw')})) AS n_matches
FROM (SELECT doc_id, {m} AS m FROM documents) WHERE len(m) > 0"""


def document_log(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per category and document, and the highest number given out."""
    events = redact_rows(documents(spark, folder)).select(
        "doc_id", F.explode("events").alias("e")
    )
    return events.groupBy("doc_id", F.col("e.category").alias("category")).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("e.placeholder").alias("placeholders"),
    )


def match_position_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = F.concat(*[
        F.transform(F.expr(match_positions("text", BY_CATEGORY[c])), _with_category(c))
        for c in GATE_CATEGORIES
    ])
    return documents(spark, folder).select("doc_id", F.explode(found).alias("m")).select(
        "doc_id", "m.category", "m.start", "m.length"
    )


def _with_category(category: str):
    return lambda m: F.struct(
        F.lit(category).alias("category"), m["start"].alias("start"), m["length"].alias("length")
    )


def positions_sql(text: str, source: str, key: str) -> str:
    """start and length of every accepted match, from the pieces between matches."""
    arms = []
    for c in GATE_CATEGORIES:
        pattern = o.lit(o.PATTERNS[c])
        arms.append(f"""
SELECT {key}, '{c}' AS category, s['at'] AS start, s['size'] AS length FROM (
  SELECT {key}, unnest(list_transform(m, lambda h, i: {{
      'at': CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT),
      'size': CAST(length(h) AS INT), 'ok': {o.valid_sql(c, 'h')}}})) AS s
  FROM (SELECT {key}, regexp_extract_all({text}, {pattern}) AS m,
      string_split_regex({text}, {pattern}) AS pieces FROM {source}) WHERE len(m) > 0
) WHERE s['ok']""")
    return " UNION ALL ".join(arms)


def redact_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of one conversation share their numbers. Customer contact lines are spliced
    in as further turns, since the given turns hold no personal data."""
    return redact_scans(spliced_turns(spark, folder), ["conv_id"], "turn").select(
        "conv_id", "turn", "text"
    )


SPLICED = """
SELECT conv_id, turn, text FROM {conversations}
UNION ALL
SELECT c_custkey % 200 AS conv_id, 1000000 + CAST(floor(c_custkey / 200) AS BIGINT) AS turn,
  'Mail user' || CAST(c_custkey % 40 AS STRING) || '@example.com or call +91 98765 '
  || lpad(CAST(c_custkey % 60 AS STRING), 5, '0') || ', tax id ABCDE'
  || lpad(CAST(c_custkey % 30 AS STRING), 4, '0') || 'F, customer: Jane Doe' AS text
FROM {customer}"""


def spliced_turns(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        SPLICED,
        conversations=spread(conversations(spark, folder)),
        customer=dealt(table(spark, folder, "customer").select("c_custkey")),
    )


def gate_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Raw documents as payloads: the gate must stop every leak."""
    payloads = documents(spark, folder).select(
        "doc_id",
        F.to_json(F.struct(F.array(F.struct("text")).alias("elements"))).alias("payload"),
    )
    return gate(payloads).select("doc_id", "blocked", "reason", "violationsCount")


def escaped_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The same payloads from a producer that escapes digits, ``@`` and blanks."""
    plain = F.to_json(F.struct(F.array(F.struct("text")).alias("elements")))
    escaped = F.regexp_replace(plain, "([0-9])", r"\\u003$1")
    escaped = F.replace(F.replace(escaped, F.lit("@"), F.lit("\\u0040")), F.lit(" "), F.lit("\\u0020"))
    return documents(spark, folder).select("doc_id", escaped.alias("payload"))


def gate_escaped_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return gate(escaped_payloads(spark, folder)).select("doc_id", "blocked", "reason", "violationsCount")


def gate_leak_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where leaks lie in those payloads as they are stored, and the six letters there."""
    found = gate(escaped_payloads(spark, folder)).select("doc_id", "payload", F.explode("violations").alias("v"))
    return found.select(
        "doc_id", "v.category", "v.index", F.expr("substr(payload, v.index + 1, 6)").alias("there")
    )


def gate_redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Redacted documents through the same gate, split into the two sinks."""
    payloads = redact_rows(documents(spark, folder)).select(
        "doc_id",
        F.to_json(F.struct(F.array(F.struct("text")).alias("elements"))).alias("payload"),
    )
    passed, quarantine = split_gate(gate(payloads))
    return (
        passed.select(F.lit("passed").alias("sink"))
        .unionByName(quarantine.select(F.lit("quarantine").alias("sink")))
        .groupBy("sink").agg(F.count(F.lit(1)).alias("payloads"))
    )


def document_violations(spark: SparkSession, folder: str) -> DataFrame:
    payloads = documents(spark, folder).select(
        "doc_id",
        F.to_json(F.struct(F.array(F.struct("text")).alias("elements"))).alias("payload"),
    )
    rows = violation_rows(gate(payloads), ["doc_id"])
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("violations"), F.countDistinct("doc_id").alias("payloads")
    )


def _doc_fold() -> tuple[str, str]:
    ctes, last = o.fold_sql("(SELECT doc_id, [text] AS texts FROM documents)", ["doc_id"])
    return f"WITH {ctes}", last


def _sql() -> dict[str, str]:
    with_, last = _doc_fold()
    total = " + ".join(f"len(flatten(k_{c}))" for c in o.PATTERNS)
    log = " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS category, len(flatten(k_{c})) AS events, "
        f"len(dk_{c}) AS placeholders FROM {last} WHERE len(dk_{c}) > 0"
        for c in o.PATTERNS
    )
    positions = positions_sql("text", "documents", "doc_id")
    spliced = SPLICED.format(conversations="conversations", customer="customer")
    conv_ctes, conv_last = o.fold_sql("grouped", ["conv_id", "turns"])
    per_doc = f"SELECT doc_id, count(*) AS n FROM ({positions}) GROUP BY doc_id"
    stored = "{x}"
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("' || chr(10) || '", "\\n"), ("' || chr(9) || '", "\\t"), ("' || chr(13) || '", "\\r")):
        stored = f"replace({stored}, '{plain}', '{escape}')"
    stored = f"replace(replace(regexp_replace({stored}, '([0-9])', '\\\\u003\\1', 'g'), '@', '\\u0040'), ' ', '\\u0020')"
    # what is left after redaction, counted on the folded text
    left_over = positions_sql("t", f"(SELECT doc_id, texts[1] AS t FROM {last})", "doc_id")
    return {
        "redact_documents": f"{with_} SELECT doc_id, texts[1] AS text, {total} AS n_events FROM {last}",
        "document_log": f"{with_} {log}",
        "match_positions": positions,
        "redact_conversations": f"""
WITH spliced AS ({spliced}),
grouped AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list(text ORDER BY turn) AS texts
  FROM spliced GROUP BY conv_id),
{conv_ctes}
SELECT conv_id, unnest(turns) AS turn, unnest(texts) AS text FROM {conv_last}""",
        "gate_documents": f"""
SELECT doc_id, n IS NOT NULL AS blocked,
  CASE WHEN n IS NOT NULL THEN 'privacy_violation' END AS reason,
  CAST(coalesce(n, 0) AS INT) AS "violationsCount"
FROM documents LEFT JOIN ({per_doc}) USING (doc_id)""",
        "gate_escaped_payloads": f"""
SELECT doc_id, n IS NOT NULL AS blocked,
  CASE WHEN n IS NOT NULL THEN 'privacy_violation' END AS reason,
  CAST(coalesce(n, 0) AS INT) AS "violationsCount"
FROM documents LEFT JOIN ({per_doc}) USING (doc_id)""",
        "gate_leak_places": f"""
WITH found AS ({positions}), stored AS (SELECT doc_id, {stored.format(x='text')} AS stored, text FROM documents)
SELECT doc_id, category, CAST(22 + length({stored.format(x='text[:start]')}) AS INT) AS index,
  substr(stored, length({stored.format(x='text[:start]')}) + 1, 6) AS there FROM found JOIN stored USING (doc_id)""",
        "gate_redacted_documents": f"""
{with_}, bad AS (SELECT DISTINCT doc_id FROM ({left_over}))
SELECT CASE WHEN bad.doc_id IS NULL THEN 'passed' ELSE 'quarantine' END AS sink,
  count(*) AS payloads FROM documents LEFT JOIN bad USING (doc_id) GROUP BY 1""",
        "document_violations": f"""
SELECT category, count(*) AS violations, count(DISTINCT doc_id) AS payloads
FROM ({positions}) GROUP BY category""",
        **{f"{c}_matches": _rule_sql(c) for c in o.PATTERNS},
    }


QUERIES = {
    "redact_documents": redact_documents,
    "document_log": document_log,
    "match_positions": match_position_rows,
    "redact_conversations": redact_conversations,
    "gate_documents": gate_documents,
    "gate_escaped_payloads": gate_escaped_payloads,
    "gate_leak_places": gate_leak_places,
    "gate_redacted_documents": gate_redacted_documents,
    "document_violations": document_violations,
    **{f"{c}_matches": _rule_query(c) for c in o.PATTERNS},
}
ORACLE = _sql()
