"""Queries over action logs, snapshots and sessions, derived from events and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.actions import action_summary, is_allowed, is_completion, navigate_reason
from ..operators.actions import planned_actions, validate_actions
from ..operators.next_action import IDLE_REASON, plan_snapshots
from ..operators.sessions import (
    latest_telemetry,
    route_requests,
    running_history,
    session_history,
    session_outcomes,
    session_stages,
    session_steps,
)
from ..sources.tables import dealt, spread, table
from .derived import form_elements_sql, form_scans

ACTION_LOG = """
SELECT event_id, user_id AS scan_id, ts,
  CASE event_id % 13 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'SELECT' WHEN 3 THEN 'CHECK'
    WHEN 4 THEN 'UNCHECK' WHEN 5 THEN 'SCROLL' WHEN 6 THEN 'NAVIGATE' WHEN 7 THEN 'WAIT'
    WHEN 8 THEN 'done' WHEN 9 THEN 'EVAL' WHEN 10 THEN 'click' WHEN 11 THEN NULL ELSE 'type' END AS action,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN 'btn-submit'
    WHEN event_id % 17 = 2 THEN ' EL_001 '
    ELSE 'el_' || lpad(CAST(event_id % 19 AS STRING), 3, '0') END AS target,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'http://site.example.com/b'
    WHEN 3 THEN 'https://site.example.com/' WHEN 4 THEN '/next' WHEN 5 THEN '//other.example.com/'
    WHEN 6 THEN 'http://' WHEN 7 THEN 'javascript:void(0)' WHEN 8 THEN 'HTTP://Site.example.com:80/x'
    WHEN 9 THEN 'file:///tmp/y' ELSE 'http://site.example.com:99999/' END AS value,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'file:///home/a.html'
    ELSE 'http://site.example.com/a?q=1' END AS current_url
FROM {events}"""


def states_sql(engine: str, customer: str) -> str:
    forms = form_elements_sql(engine, customer)
    return f"""
SELECT scan_id, id, tag, CASE WHEN ord = 13 THEN 'checkbox' ELSE NULL END AS role,
  CASE WHEN tag = 'input' THEN type ELSE NULL END AS input_type,
  ord = 6 AND scan_id % 4 = 0 AS disabled, NOT (ord = 9 AND scan_id % 5 = 0) AS visible
FROM ({forms}) AS f WHERE id IS NOT NULL"""


def action_log(spark: SparkSession, folder: str) -> DataFrame:
    events = spread(table(spark, folder, "events").select("event_id", "user_id", "ts"))
    return spark.sql(ACTION_LOG, events=events)


def element_states(spark: SparkSession, folder: str) -> DataFrame:
    customer = dealt(table(spark, folder, "customer").select("c_custkey"))
    return spark.sql(states_sql("spark", "{customer}"), customer=customer)


def validated(spark: SparkSession, folder: str) -> DataFrame:
    return validate_actions(action_log(spark, folder), element_states(spark, folder))


def validate_action_rows(spark: SparkSession, folder: str) -> DataFrame:
    return validated(spark, folder).select("event_id", "valid", "reason")


def action_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return action_log(spark, folder).select(
        "event_id",
        F.expr(is_allowed("action")).alias("allowed"),
        F.expr(is_completion("action")).alias("completion"),
        F.expr(action_summary("action", "target")).alias("summary"),
    )


def navigate_origin(spark: SparkSession, folder: str) -> DataFrame:
    """Every value as a destination, in the strict and in the compatible reading."""
    return action_log(spark, folder).where("coalesce(value, '') <> ''").select(
        "event_id",
        F.expr(navigate_reason("value", "current_url")).alias("strict_reason"),
        F.expr(navigate_reason("value", "current_url", compat=True)).alias("compat_reason"),
    )


def rejection_counts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.regexp_extract(F.coalesce("reason", F.lit("valid")), "^([A-Za-z]+(?: [a-z]+)?)", 1)
    return validated(spark, folder).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("actions")
    )


RESPONSES = """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN '{"status":"success","action":{"action":"CLICK","target":"el_00' || CAST(event_id % 9 AS STRING) || '","reason":"go"}}'
  WHEN 1 THEN '{"action":"TYPE","target":"el_001","value":"v' || CAST(event_id % 9 AS STRING) || '"}'
  WHEN 2 THEN '{"action":"DONE"}' WHEN 3 THEN '{"target":"el_002","reason":"r"}'
  ELSE 'not json' END AS response FROM {events}"""


def planner_responses(spark: SparkSession, folder: str) -> DataFrame:
    events = spread(table(spark, folder, "events").select("event_id"))
    sql = RESPONSES.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")
    return planned_actions(spark.sql(sql, events=events)).drop("response")


GOALS = """CASE {k} % 9 WHEN 0 THEN 'Submit Verified Profile' WHEN 1 THEN ' VERIFY my KYC '
  WHEN 2 THEN 'click continue' WHEN 3 THEN 'please press submit' WHEN 4 THEN 'Navigate to http://a.example.com/'
  WHEN 5 THEN 'go to  /home' WHEN 6 THEN 'wait a moment' WHEN 7 THEN 'read it' ELSE NULL END"""
CASES = """CASE {k} % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'clicked' WHEN 2 THEN 'final' ELSE 'navigated' END"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A form, a goal and a history per customer; one in ten forms is empty."""
    scans = form_scans(spark, folder)
    goal = GOALS.format(k="scan_id")
    case = CASES.format(k="scan_id")

    def entry(action: str, target: str, reason: str) -> str:
        return (
            f"array(named_struct('step', 1, 'action', named_struct('action', '{action}', 'target', {target}, "
            f"'value', CAST(NULL AS STRING), 'reason', '{reason}'), 'success', true, "
            "'timestamp', CAST(NULL AS TIMESTAMP)))"
        )

    history = f"""CASE {case} WHEN 'clicked' THEN {entry('CLICK', "'el_014'", 'Next page')}
WHEN 'final' THEN {entry('CLICK', "'el_003'", 'Final step reached')}
WHEN 'navigated' THEN {entry('NAVIGATE', 'CAST(NULL AS STRING)', 'asked')} ELSE NULL END"""
    return scans.select(
        "scan_id",
        F.expr("if(scan_id % 10 = 9, slice(elements, 1, 0), elements)").alias("elements"),
        F.expr(goal).alias("goal"),
        F.expr(history).alias("history"),
    )


def next_actions(spark: SparkSession, folder: str) -> DataFrame:
    return plan_snapshots(snapshots(spark, folder)).select("scan_id", "next.*")


# A loop record per event; outcome flags follow from the event's own columns.
LOOP_RECORDS = """
SELECT user_id AS session_id, event_id AS record_id, ts,
  CASE WHEN event_id % 29 = 0 THEN 'DONE' WHEN event_id % 23 = 0 THEN 'WAIT'
    WHEN event_type = 'click' THEN 'CLICK' WHEN event_type = 'signup' THEN 'TYPE'
    WHEN event_type = 'purchase' THEN 'SELECT' WHEN event_type = 'view' THEN 'SCROLL'
    ELSE 'WAIT' END AS action,
  CASE WHEN event_type IN ('click', 'signup', 'purchase') AND event_id % 29 <> 0 AND event_id % 23 <> 0
    THEN 'el_' || lpad(CAST(event_id % 17 + 1 AS STRING), 3, '0') ELSE NULL END AS target,
  CASE WHEN event_id % 23 = 0 THEN 'no actionable target found' ELSE 'planned' END AS reason,
  event_id % 31 = 0 AS blocked,
  CASE WHEN event_id % 37 = 0 THEN 'timeout' ELSE NULL END AS network_error,
  event_id % 19 <> 0 AS valid,
  CASE WHEN event_id % 19 = 0 THEN 'disabled target' ELSE NULL END AS rejection,
  NOT (event_type = 'error' AND event_id % 2 = 0) AS success
FROM {events}"""


def loop_records(spark: SparkSession, folder: str) -> DataFrame:
    events = spread(table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type"))
    return spark.sql(LOOP_RECORDS, events=events)


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return session_steps(loop_records(spark, folder))


def session_step_rows(spark: SparkSession, folder: str) -> DataFrame:
    return steps(spark, folder).select("session_id", "record_id", "step", "stage", "status")


def session_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return session_outcomes(steps(spark, folder))


def session_stage_rows(spark: SparkSession, folder: str) -> DataFrame:
    return session_stages(steps(spark, folder))


def session_history_rows(spark: SparkSession, folder: str) -> DataFrame:
    h = session_history(steps(spark, folder))
    shown = F.transform("history", lambda e: F.concat_ws(":", e["step"], e["action"], e["target"]))
    return h.select("session_id", F.array_join(shown, ",").alias("history"))


def step_audit(spark: SparkSession, folder: str) -> DataFrame:
    return running_history(steps(spark, folder)).select("session_id", "record_id", "so_far")


def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    return session_outcome(spark, folder).groupBy("status", "response", "label").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("step_count").alias("steps")
    )


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return latest_telemetry(steps(spark, folder))


REQUESTS = """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'PING_TEST' ELSE 'PLAN_ACTION' END AS action,
  CASE WHEN event_type = 'view' THEN 'submit' WHEN event_type = 'error' THEN '' ELSE NULL END AS goal,
  CASE WHEN event_type = 'click' THEN props ELSE NULL END AS context FROM {events}"""


def request_router(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    return route_requests(spark.sql(REQUESTS, events=events)).select("event_id", "route")


def _validate_sql() -> str:
    kinds = "('CLICK','TYPE','SELECT','CHECK','UNCHECK','SCROLL','NAVIGATE','WAIT')"
    return f"""
log AS ({ACTION_LOG.format(events='events')}), st AS ({states_sql('duck', 'customer')}),
u AS (SELECT *, upper(action) AS kind FROM log),
sch AS (SELECT *, CASE WHEN kind = 'DONE' THEN NULL
  WHEN kind IS NULL OR kind NOT IN {kinds} THEN 'unsupported action ' || coalesce(action, 'null')
  WHEN kind IN ('NAVIGATE', 'WAIT') THEN CASE WHEN kind = 'NAVIGATE' AND coalesce(value, '') = '' THEN 'NAVIGATE needs a URL' END
  WHEN coalesce(target, '') = '' THEN kind || ' needs a target'
  WHEN NOT regexp_full_match(trim(target), '(?i)el_[0-9]+') THEN 'bad target format ' || target
  WHEN kind IN ('TYPE', 'SELECT') AND value IS NULL THEN kind || ' needs a value' END AS sr FROM u),
nav AS (SELECT *, {_navigate_sql(False)} AS nr, {_navigate_sql(True)} AS nc FROM sch),
j AS (SELECT nav.*, st.id AS sid, st.tag, coalesce(role, '') AS role, coalesce(input_type, '') AS it, disabled, visible
  FROM nav LEFT JOIN st ON st.scan_id = nav.scan_id AND st.id = nav.target),
verdict AS (SELECT *, CASE
  WHEN sr IS NOT NULL THEN 'Schema violation: ' || sr
  WHEN kind = 'NAVIGATE' THEN nr WHEN kind IN ('WAIT', 'DONE') THEN NULL
  WHEN sid IS NULL THEN 'unknown target ' || target
  WHEN disabled THEN 'disabled target ' || target WHEN NOT visible THEN 'hidden target ' || target
  WHEN kind = 'CLICK' AND NOT (tag IN ('button', 'a') OR (tag = 'input' AND it IN ('button','submit','reset','image'))
    OR role IN ('button','link','menuitem','tab')) THEN 'not clickable: ' || tag
  WHEN kind = 'TYPE' AND NOT (tag = 'textarea' OR (tag = 'input' AND it NOT IN
    ('button','submit','reset','image','checkbox','radio','file','hidden'))) THEN 'not a text control: ' || tag
  WHEN kind = 'SELECT' AND tag <> 'select' THEN 'not a select: ' || tag
  WHEN kind IN ('CHECK', 'UNCHECK') AND NOT ((tag = 'input' AND it IN ('checkbox','radio')) OR role IN ('checkbox','radio'))
    THEN 'not checkable: ' || tag END AS reason FROM j)"""


def _navigate_sql(compat: bool) -> str:
    """The eleven kinds of destination in the log, judged one by one."""
    none = "NULL" if compat else "'no current page to compare with'"
    opaque = "NULL" if compat else "'cross-origin ' || value"
    return f"""CASE
WHEN coalesce(value, '') = '' THEN NULL
WHEN value = '/next' THEN CASE WHEN current_url IS NULL THEN {none} END
WHEN value = '//other.example.com/' THEN CASE WHEN current_url IS NULL THEN {none}
  WHEN current_url LIKE 'file:%' THEN NULL ELSE 'cross-origin ' || value END
WHEN value IN ('http://', 'http://site.example.com:99999/') THEN 'malformed URL ' || value
WHEN current_url IS NULL THEN {none}
WHEN value LIKE 'file:%' THEN CASE WHEN current_url LIKE 'file:%' THEN NULL ELSE 'cross-origin ' || value END
WHEN value LIKE 'javascript:%' THEN CASE WHEN current_url LIKE 'file:%' THEN {opaque} ELSE 'cross-origin ' || value END
WHEN current_url LIKE 'http:%' AND value IN ('http://site.example.com/b', 'HTTP://Site.example.com:80/x') THEN NULL
ELSE 'cross-origin ' || value END"""


def _next_sql() -> str:
    """First matching element per band, by rank over element rows."""
    goal, case = GOALS.format(k="scan_id"), CASES.format(k="scan_id")
    return f"""
WITH forms AS MATERIALIZED ({form_elements_sql('duck')}),
snaps AS (SELECT c_custkey AS scan_id, {goal.replace('scan_id', 'c_custkey')} AS goal,
  {case.replace('scan_id', 'c_custkey')} AS past FROM customer),
els AS (SELECT f.*, lower(coalesce(nullif(text, ''), nullif(label, ''), nullif(value, ''), '')) AS shown,
  tag = 'button' OR type IN ('button', 'submit') AS btn FROM forms f WHERE scan_id % 10 <> 9),
g AS (SELECT *, lower(trim(coalesce(goal, ''))) AS want FROM snaps),
w AS (SELECT *, trim(regexp_replace(want, '^(click|press)\\s+', '')) AS wanted FROM g),
m AS (SELECT w.scan_id, any_value(goal) AS goal, any_value(want) AS want, any_value(past) AS past,
  count(e.ord) AS n,
  arg_min(e.id, e.ord) FILTER (WHERE btn AND (shown LIKE '%submit verified profile%' OR shown LIKE '%submit profile%'
    OR e.name = 'submit') AND shown NOT LIKE '%continue%' AND shown NOT LIKE '%next%') AS fin,
  arg_min(e.id, e.ord) FILTER (WHERE btn AND (shown LIKE '%continue%' OR shown LIKE '%next%' OR shown LIKE '%step%')) AS fwd,
  arg_min(e.id, e.ord) FILTER (WHERE btn AND (shown LIKE '%submit%' OR shown LIKE '%verify%' OR shown LIKE '%profile%')) AS any_btn,
  arg_min(e.id, e.ord) FILTER (WHERE contains(shown, wanted) OR contains(lower(coalesce(e.name, '')), wanted)) AS hit
  FROM w LEFT JOIN els e ON e.scan_id = w.scan_id GROUP BY w.scan_id),
plan AS (SELECT *, CASE
  WHEN n = 0 THEN ['WAIT', NULL, NULL, 'No elements to act on']
  WHEN (want LIKE '%submit%' OR want LIKE '%verify%' OR want LIKE '%profile%') AND past = 'final'
    THEN ['DONE', NULL, NULL, 'Goal reached: profile submitted.']
  WHEN (want LIKE '%submit%' OR want LIKE '%verify%' OR want LIKE '%profile%') AND fin IS NOT NULL
    THEN ['CLICK', fin, NULL, 'Final step: ' || fin]
  WHEN (want LIKE '%submit%' OR want LIKE '%verify%' OR want LIKE '%profile%') AND fwd IS NOT NULL
    THEN ['CLICK', fwd, NULL, 'Next page: ' || fwd]
  WHEN (want LIKE '%submit%' OR want LIKE '%verify%' OR want LIKE '%profile%') AND any_btn IS NOT NULL
    THEN CASE WHEN past <> 'none' THEN ['DONE', NULL, NULL, 'Goal reached: ' || any_btn]
      ELSE ['CLICK', any_btn, NULL, 'Matching button: ' || any_btn] END
  WHEN (want LIKE 'click %' OR want LIKE '%press %') AND hit IS NOT NULL
    THEN CASE WHEN (past = 'clicked' AND hit = 'el_014') OR (past = 'final' AND hit = 'el_003')
      THEN ['DONE', NULL, NULL, 'Goal reached: ' || hit] ELSE ['CLICK', hit, NULL, 'Named target: ' || hit] END
  WHEN want LIKE 'navigate to %' OR want LIKE 'go to %'
    THEN CASE WHEN past = 'navigated' THEN ['DONE', NULL, NULL, 'Goal reached: navigated.']
      ELSE ['NAVIGATE', NULL, trim(regexp_replace(goal, '(?i)^(navigate to|go to)\\s+', '')), 'Goal asks for navigation.'] END
  WHEN want LIKE '%wait%' THEN ['WAIT', NULL, NULL, 'Goal asks to wait.']
  ELSE ['WAIT', NULL, NULL, '{IDLE_REASON}'] END AS p FROM m)
SELECT scan_id, p[1] AS action, p[2] AS target, p[3] AS value, p[4] AS reason FROM plan"""


def _steps_sql() -> str:
    return f"""
recs AS ({LOOP_RECORDS.format(events='events')}),
kinds AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN network_error IS NOT NULL THEN 'error'
  WHEN action = 'DONE' THEN 'completed'
  WHEN action = 'WAIT' AND reason = 'no actionable target found' THEN 'idle'
  WHEN NOT valid THEN 'rejected' WHEN NOT success THEN 'failed' ELSE 'step' END AS kind FROM recs),
run AS (SELECT *, row_number() OVER w AS rn,
  sum(CASE WHEN kind <> 'step' THEN 1 ELSE 0 END) OVER w AS ends,
  sum(CASE WHEN kind IN ('step', 'rejected', 'failed') THEN 1 ELSE 0 END) OVER w AS step
  FROM kinds WINDOW w AS (PARTITION BY session_id ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING)),
steps AS MATERIALIZED (SELECT *, CASE kind WHEN 'blocked' THEN 'privacy_firewall' WHEN 'error' THEN 'planner'
    WHEN 'completed' THEN 'loop_action' WHEN 'idle' THEN 'loop_action' ELSE 'action_execution' END AS stage,
  CASE WHEN kind = 'step' AND step = 10 THEN 'max_steps_reached' WHEN kind = 'step' THEN 'success' ELSE kind END AS status
  FROM run WHERE rn <= 10 AND (ends = 0 OR (ends = 1 AND kind <> 'step'))),
outcome AS (SELECT session_id, CAST(max(step) AS INT) AS step_count,
  count(*) FILTER (WHERE kind = 'step') AS history_length, count(*) AS records,
  coalesce(max(status) FILTER (WHERE status <> 'success'), 'running') AS status FROM steps GROUP BY 1),
outcomes AS (SELECT *, CASE status WHEN 'completed' THEN 'success' WHEN 'blocked' THEN 'blocked'
    WHEN 'rejected' THEN 'rejected' ELSE 'error' END AS response,
  CASE status WHEN 'completed' THEN 'Done' WHEN 'blocked' THEN 'Blocked' WHEN 'rejected' THEN 'Rejected'
    ELSE 'Failed' END AS label FROM outcome)"""


def _sql() -> dict[str, str]:
    log = ACTION_LOG.format(events="events")
    s = f"WITH {_steps_sql()}"
    return {
        "validate_actions": f"WITH {_validate_sql()} SELECT event_id, reason IS NULL AS valid, reason FROM verdict",
        "action_kinds": f"""
SELECT event_id, coalesce(upper(action) IN ('CLICK','TYPE','SELECT','CHECK','UNCHECK','SCROLL','NAVIGATE','WAIT'), FALSE) AS allowed,
  coalesce(upper(action) = 'DONE', FALSE) AS completion,
  trim(concat_ws(' ', action, target)) AS summary FROM ({log})""",
        "navigate_origin": f"""
SELECT event_id, {_navigate_sql(False)} AS strict_reason, {_navigate_sql(True)} AS compat_reason
FROM ({log}) WHERE coalesce(value, '') <> ''""",
        "rejection_counts": f"""
WITH {_validate_sql()} SELECT regexp_extract(coalesce(reason, 'valid'), '^([A-Za-z]+(?: [a-z]+)?)', 1) AS kind,
  count(*) AS actions FROM verdict GROUP BY 1""",
        "planner_responses": """
SELECT event_id, event_id % 5 IN (0, 1, 3) AS is_object,
  CASE event_id % 5 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'DONE' END AS action,
  CASE event_id % 5 WHEN 0 THEN 'el_00' || event_id % 9 WHEN 1 THEN 'el_001' WHEN 3 THEN 'el_002' END AS target,
  CASE event_id % 5 WHEN 1 THEN 'v' || event_id % 9 END AS value,
  CASE event_id % 5 WHEN 0 THEN 'go' WHEN 3 THEN 'r' END AS reason FROM events""",
        "next_action": _next_sql(),
        "session_steps": f"{s} SELECT session_id, record_id, CAST(step AS INT) AS step, stage, status FROM steps",
        "session_stages": f"""
{s} SELECT session_id, CAST(1 + row_number() OVER (PARTITION BY session_id ORDER BY ts, record_id) AS INT) AS seq, stage, status,
  CAST(step AS INT) AS step, CASE status WHEN 'blocked' THEN 'payload blocked by the gate'
    WHEN 'error' THEN 'network error: ' || network_error WHEN 'completed' THEN reason WHEN 'idle' THEN 'no actionable target'
    WHEN 'rejected' THEN 'action rejected: ' || rejection WHEN 'failed' THEN 'execution failed'
    WHEN 'max_steps_reached' THEN 'max steps reached' END AS stop_reason FROM steps
UNION ALL SELECT DISTINCT session_id, o.seq, o.stage, 'success', 0, NULL
  FROM steps, (VALUES (0, 'tab_query'), (1, 'initial_perception')) AS o(seq, stage)""",
        "session_outcome": f"{s} SELECT * FROM outcomes",
        "session_history": f"""
{s} SELECT session_id, string_agg(concat_ws(':', CAST(step AS INT), action, target), ',' ORDER BY step) AS history
FROM steps WHERE kind = 'step' GROUP BY 1""",
        "step_audit": f"""
{s} SELECT session_id, record_id, coalesce(string_agg(CASE WHEN kind = 'step' THEN trim(concat_ws(' ', action, target)) END, ' > ')
  OVER (PARTITION BY session_id ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING), '') AS so_far FROM steps""",
        "outcome_counts": f"""
{s} SELECT status, response, label, count(*) AS sessions, CAST(sum(step_count) AS BIGINT) AS steps
FROM outcomes GROUP BY 1, 2, 3""",
        "latest_telemetry": f"""
{s} SELECT session_id, CAST(step AS INT) AS step, trim(concat_ws(' ', action, target)) AS last_action, status,
  CASE WHEN status = 'rejected' THEN rejection END AS rejection,
  CASE WHEN status = 'rejected' THEN 'warn' WHEN status IN ('failed', 'blocked') THEN 'error'
    WHEN status = 'completed' THEN 'success' ELSE 'info' END AS severity
FROM steps QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, record_id DESC) = 1""",
        "request_router": f"""
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'ping'
  WHEN event_type IN ('view', 'click') THEN 'plan' ELSE 'echo' END AS route FROM events""",
    }


QUERIES = {
    "validate_actions": validate_action_rows,
    "action_kinds": action_kinds,
    "navigate_origin": navigate_origin,
    "rejection_counts": rejection_counts,
    "planner_responses": planner_responses,
    "next_action": next_actions,
    "session_steps": session_step_rows,
    "session_stages": session_stage_rows,
    "session_outcome": session_outcome,
    "session_history": session_history_rows,
    "step_audit": step_audit,
    "outcome_counts": outcome_counts,
    "latest_telemetry": telemetry,
    "request_router": request_router,
}
ORACLE = _sql()
