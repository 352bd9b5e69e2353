"""The observe-and-act loop as a table of step records.

A record says what one turn of the loop saw: the gate's verdict, the planned action,
the validator's answer, the outcome. Every record either ends its session or uses up
one of ten steps, so a session is decided by its first eleven records. That bound is
applied first: Spark keeps at most eleven rows per session and map task before it
shuffles, whatever the length of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.actions import action_summary
from .next_action import IDLE_REASON
from .numbering import evaluate_once

MAX_STEPS = 10


def stage_status(prefix: str = "") -> str:
    """What one record does to its session: a terminal status, or ``step``."""
    p = prefix
    return f"""CASE
WHEN coalesce({p}blocked, false) THEN 'blocked'
WHEN {p}network_error IS NOT NULL THEN 'error'
WHEN {p}action <=> 'DONE' THEN 'completed'
WHEN {p}action <=> 'WAIT' AND {p}reason <=> '{IDLE_REASON}' THEN 'idle'
WHEN NOT coalesce({p}valid, true) THEN 'rejected'
WHEN NOT coalesce({p}success, false) THEN 'failed'
ELSE 'step' END"""


def session_steps(
    records: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("ts", "record_id")
) -> DataFrame:
    """The records that were reached, with ``step`` (steps used so far), ``stage`` and
    ``status``; records after the end of a session are gone."""
    by_time = Window.partitionBy(session).orderBy(*order)
    head = records.withColumn("_rn", F.row_number().over(by_time)).where(
        F.col("_rn") <= MAX_STEPS + 1
    )
    marked = evaluate_once(head, _st=stage_status())
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    executed = F.col("_st").isin("step", "rejected", "failed").cast("int")
    ended = (F.col("_st") != "step").cast("int")
    counted = (
        marked.withColumn("step", F.sum(executed).over(so_far).cast("int"))
        .withColumn("_ended", F.coalesce(F.max(ended).over(before), F.lit(0)))
        .withColumn("_used", F.col("_rn") - 1)
        .where((F.col("_ended") == 0) & (F.col("_used") < MAX_STEPS))
    )
    status = F.when(
        (F.col("_st") == "step") & (F.col("step") >= MAX_STEPS), "max_steps_reached"
    ).when(F.col("_st") == "step", "success").otherwise(F.col("_st"))
    stage = F.expr("""CASE WHEN _st = 'blocked' THEN 'privacy_firewall' WHEN _st = 'error' THEN 'planner'
WHEN _st IN ('completed', 'idle') THEN 'loop_action' ELSE 'action_execution' END""")
    return (
        counted.withColumn("stage", stage).withColumn("status", status)
        .drop("_rn", "_st", "_ended", "_used")
    )


def response_status(status: str) -> str:
    return (
        f"CASE {status} WHEN 'completed' THEN 'success' WHEN 'blocked' THEN 'blocked' "
        "WHEN 'rejected' THEN 'rejected' ELSE 'error' END"
    )


def display_label(status: str) -> str:
    return (
        f"CASE {status} WHEN 'completed' THEN 'Done' WHEN 'blocked' THEN 'Blocked' "
        "WHEN 'rejected' THEN 'Rejected' ELSE 'Failed' END"
    )


def severity(status: str, rejection: str) -> str:
    return (
        f"CASE WHEN {rejection} IS NOT NULL THEN 'warn' WHEN {status} IN ('failed', 'blocked') "
        f"THEN 'error' WHEN {status} = 'completed' THEN 'success' ELSE 'info' END"
    )


def session_outcomes(steps: DataFrame, session: str = "session_id") -> DataFrame:
    """One row per session. A session without a terminal record is still ``running``.

    ``steps`` has at most ten or eleven rows per session by construction.
    """
    terminal = ~F.col("status").isin("success")
    out = steps.groupBy(session).agg(
        F.max("step").alias("step_count"),
        F.max(F.when(terminal, F.col("status"))).alias("_terminal"),
        F.count(F.when(F.col("status").isin("success", "max_steps_reached"), 1)).alias("history_length"),
        F.count(F.lit(1)).alias("records"),
    )
    return (
        out.withColumn("status", F.coalesce("_terminal", F.lit("running"))).drop("_terminal")
        .withColumn("response", F.expr(response_status("status")))
        .withColumn("label", F.expr(display_label("status")))
    )


def stop_reason(status: str = "status") -> str:
    """Why a session ended with this record; null where it goes on."""
    return f"""CASE {status}
WHEN 'blocked' THEN 'payload blocked by the gate'
WHEN 'error' THEN concat('network error: ', network_error)
WHEN 'completed' THEN coalesce(nullif(reason, ''), 'goal reached')
WHEN 'idle' THEN 'no actionable target'
WHEN 'rejected' THEN concat('action rejected: ', coalesce(rejection, 'unknown'))
WHEN 'failed' THEN 'execution failed'
WHEN 'max_steps_reached' THEN 'max steps reached' END"""


def session_stages(steps: DataFrame, session: str = "session_id") -> DataFrame:
    """Every stage of a session in order: (session, seq, stage, status, step, stop_reason). The
    tab is found and the page is read first of all (step 0), then come the records that were
    reached. ``stop_reason`` stands in the row that ends the session.

    ``steps`` has at most ten or eleven rows per session by construction.
    """
    row = F.struct(
        "ts", "record_id", "stage", "status", F.col("step").cast("int").alias("step"),
        F.expr(stop_reason()).alias("stop_reason"),
    )
    opening = [
        f"named_struct('stage', '{s}', 'status', 'success', 'step', 0, 'stop_reason', CAST(NULL AS STRING))"
        for s in ("tab_query", "initial_perception")
    ]
    listed = steps.groupBy(session).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    slim = "transform(rows, r -> struct(r.stage, r.status, r.step, r.stop_reason))"
    return listed.select(
        session, F.posexplode(F.expr(f"concat(array({', '.join(opening)}), {slim})")).alias("seq", "s")
    ).select(session, "seq", "s.*")


def session_history(steps: DataFrame, session: str = "session_id") -> DataFrame:
    """Successful steps in order, as one list per session (ten entries at most)."""
    done = steps.where(F.col("status").isin("success", "max_steps_reached"))
    entry = F.struct("step", "action", "target", "ts")
    return done.groupBy(session).agg(F.sort_array(F.collect_list(entry)).alias("history"))


def running_history(steps: DataFrame, session: str = "session_id") -> DataFrame:
    """The actions a session had behind it at each record, this one included."""
    frame = Window.partitionBy(session).orderBy("ts", "record_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ok = F.when(
        F.col("status").isin("success", "max_steps_reached"), F.expr(action_summary("action", "target"))
    )
    return steps.withColumn("so_far", F.concat_ws(" > ", F.collect_list(ok).over(frame)))


def latest_telemetry(steps: DataFrame, session: str = "session_id") -> DataFrame:
    """The newest progress record of each session: a map-side combined aggregate."""
    rejected = F.when(F.col("status") == "rejected", F.col("rejection"))
    row = F.struct(
        "step", F.expr(action_summary("action", "target")).alias("last_action"), "status",
        rejected.alias("rejection"),
    )
    newest = steps.groupBy(session).agg(F.max_by(row, F.struct("ts", "record_id")).alias("r"))
    return newest.select(session, "r.*").withColumn(
        "severity", F.expr(severity("status", "rejection"))
    )


def route_requests(requests: DataFrame) -> DataFrame:
    """Ping, plan or echo."""
    return requests.withColumn(
        "route",
        F.expr(
            "CASE WHEN action <=> 'PING_TEST' THEN 'ping' "
            "WHEN context IS NOT NULL OR coalesce(goal, '') <> '' THEN 'plan' ELSE 'echo' END"
        ),
    )
