"""Rule labelling of session snapshots: the one next action for each.

A snapshot is a row with ``elements`` (at most 200), ``goal`` and ``history``. The
planner is a column expression, so another one can be put in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import let, strip
from .numbering import evaluate_once

HISTORY = (
    "array<struct<step:int,action:struct<action:string,target:string,value:string,"
    "reason:string>,success:boolean,timestamp:timestamp>>"
)
# Words that steer the choice.
IDLE_REASON = "no actionable target found"
CONFIRMATIONS = ("verification complete", "successfully submitted")
FINAL_TEXTS = ("submit verified profile", "submit profile")
FORWARD_TEXTS = ("continue", "next", "step")
SUBMIT_WORDS = ("submit", "verify", "profile")
FINAL_REASON = "(?i)submit verified profile|final step"


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _shown(e: str, *fields: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({e}.{f}, '')" for f in fields) + ", '')"


def _action(action: str, target: str, value: str, reason: str) -> str:
    null = "CAST(NULL AS STRING)"
    return (
        f"named_struct('action', '{action}', 'target', {target or null}, "
        f"'value', {value or null}, 'reason', {reason})"
    )


def next_action(elements: str = "elements", goal: str = "goal", history: str = "history") -> str:
    """struct(action, target, value, reason)."""
    button = "(e.tag <=> 'button' OR e.type <=> 'button' OR e.type <=> 'submit')"
    text = f"lower({_shown('e', 'text', 'label', 'value')})"
    final = (
        f"({_any(text, FINAL_TEXTS)} OR e.name <=> 'submit' OR contains(coalesce(e.id, ''), 'btn-submit')) "
        f"AND NOT {_any(text, ('continue', 'next'))}"
    )

    def first(test: str) -> str:
        return f"get(filter(els, e -> {test}), 0)"

    confirmed = (
        f"(size(past) > 0 AND exists(els, e -> {_any('lower(' + _shown('e', 'text', 'label') + ')', CONFIRMATIONS)}))"
    )
    submitted = (
        "exists(past, h -> h.action.action <=> 'CLICK' AND coalesce(h.success, false) AND "
        f"(h.action.target <=> 'btn-submit-pii' OR coalesce(rlike(h.action.reason, '{FINAL_REASON}'), false)))"
    )
    shown = "concat(' ', {x}.id)"
    submit = let("fin", first(f"{button} AND {final}"), let(
        "fwd", first(f"{button} AND {_any(text, FORWARD_TEXTS)}"), let(
            "any_btn", first(f"{button} AND {_any(text, SUBMIT_WORDS)}"), f"""CASE
WHEN {confirmed} OR {submitted} THEN {_action('DONE', '', '', "'Goal reached: profile submitted.'")}
WHEN fin IS NOT NULL THEN {_action('CLICK', 'fin.id', '', f"concat('Final step:', {shown.format(x='fin')})")}
WHEN fwd IS NOT NULL THEN {_action('CLICK', 'fwd.id', '', f"concat('Next page:', {shown.format(x='fwd')})")}
WHEN any_btn IS NOT NULL AND size(past) > 0
  THEN {_action('DONE', '', '', f"concat('Goal reached:', {shown.format(x='any_btn')})")}
WHEN any_btn IS NOT NULL
  THEN {_action('CLICK', 'any_btn.id', '', f"concat('Matching button:', {shown.format(x='any_btn')})")}
END""")))
    named = let("wanted", f"{strip('regexp_replace(want, ' + repr('^(?:click|press)[ ]+') + ', ' + repr('') + ')')}", let(
        "hit",
        first(f"contains({text}, wanted) OR contains(lower(coalesce(e.name, '')), wanted)"),
        f"""CASE
WHEN hit IS NULL THEN NULL
WHEN exists(past, h -> h.action.target <=> hit.id)
  THEN {_action('DONE', '', '', f"concat('Goal reached:', {shown.format(x='hit')})")}
ELSE {_action('CLICK', 'hit.id', '', f"concat('Named target:', {shown.format(x='hit')})")} END""",
    ))
    url = strip(f"regexp_replace({goal}, '(?i)^(?:navigate to|go to)[ ]+', '')")
    navigate = f"""CASE
WHEN exists(past, h -> h.action.action <=> 'NAVIGATE')
  THEN {_action('DONE', '', '', "'Goal reached: navigated.'")}
ELSE {_action('NAVIGATE', '', url, "'Goal asks for navigation.'")} END"""
    plan = f"""CASE
WHEN size(els) = 0 THEN {_action('WAIT', '', '', "'No elements to act on'")}
ELSE coalesce(
  CASE WHEN {_any('want', SUBMIT_WORDS)} THEN {submit} END,
  CASE WHEN startswith(want, 'click ') OR contains(want, 'press ') THEN {named} END,
  CASE WHEN startswith(want, 'navigate to ') OR startswith(want, 'go to ') THEN {navigate} END,
  CASE WHEN contains(want, 'wait') THEN {_action('WAIT', '', '', "'Goal asks to wait.'")} END,
  {_action('WAIT', '', '', f"'{IDLE_REASON}'")}) END"""
    return let(
        "els", f"coalesce({elements}, array())",
        let("past", f"coalesce({history}, CAST(array() AS {HISTORY}))",
            let("want", f"lower({strip(f'coalesce({goal}, {chr(39)*2})')})", plan)),
    )


def plan_snapshots(snapshots: DataFrame) -> DataFrame:
    """Add ``next``: struct(action, target, value, reason)."""
    return evaluate_once(snapshots, next=next_action())
