"""Auditing an action log against element tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.actions import (
    compatibility_reason,
    is_completion,
    navigate_reason,
    planned_action,
    schema_reason,
)
from .numbering import evaluate_once

STATE_FIELDS = ("tag", "role", "input_type", "disabled", "visible")


def validate_actions(
    actions: DataFrame, states: DataFrame, scan: str = "scan_id", compat: bool = False
) -> DataFrame:
    """Add ``valid`` and ``reason``: the first check that fails decides.

    ``actions``: scan, action, target, value, current_url and, from ``planned_actions``,
    is_object. ``states``: scan, id, tag,
    role, input_type, disabled, visible; ids are unique in a scan. Only actions that need
    an element are joined; the rest pass by, and adaptive execution splits a scan that
    dominates the log.
    """
    checked = evaluate_once(
        actions,
        _schema=schema_reason(
            "action", "target", "value",
            "coalesce(is_object, false)" if "is_object" in actions.columns else "true",
        ),
        _navigate=f"CASE WHEN upper(action) = 'NAVIGATE' AND coalesce(value, '') <> '' "
                  f"THEN {navigate_reason('value', 'current_url', compat)} END",
    )
    needs = (
        f"_schema IS NULL AND NOT {is_completion('action')} "
        "AND upper(action) NOT IN ('NAVIGATE', 'WAIT')"
    )
    keyed = checked.withColumn("_target", F.expr(f"CASE WHEN {needs} THEN target END"))
    found = states.select(
        F.col(scan).alias("_scan"), F.col("id").alias("_id"),
        *[F.col(c).alias(f"_{c}") for c in STATE_FIELDS],
    )
    joined = keyed.where("_target IS NOT NULL").join(
        found, (F.col(scan) == F.col("_scan")) & (F.col("_target") == F.col("_id")), "left"
    )
    reason = f"""CASE
WHEN _id IS NULL THEN concat('unknown target ', target)
WHEN coalesce(_disabled, false) THEN concat('disabled target ', target)
WHEN NOT coalesce(_visible, true) THEN concat('hidden target ', target)
ELSE {compatibility_reason('action', '_tag', '_role', '_input_type')} END"""
    with_target = joined.select(*actions.columns, F.expr(reason).alias("reason"))
    without = keyed.where("_target IS NULL").select(
        *actions.columns,
        F.expr("coalesce(concat('Schema violation: ', _schema), _navigate)").alias("reason"),
    )
    return with_target.unionByName(without).withColumn("valid", F.col("reason").isNull())


def planned_actions(responses: DataFrame, response: str = "response") -> DataFrame:
    return evaluate_once(responses, _a=planned_action(response)).select(
        *responses.columns, "_a.*"
    )
