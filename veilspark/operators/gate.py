"""The fail-closed gate: independent checks of a finished payload.

A payload is one JSON string per row. Structural rules read its elements; text rules
scan the payload itself. Verdict columns are computed in the row, so gating is a
narrow stage and both sides of the split can be written from one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import match_positions
from ..functions.rules import GATE_RULES, PiiRule
from ..functions.text import holds_placeholder, let
from .numbering import evaluate_once

VIOLATION = "struct<category:string,elementId:string,index:int,detail:string>"
GATE_ELEMENT = (
    "id string, selector string, type string, category string, value string, "
    "sensitive boolean, visualScanFailed boolean"
)
CREDENTIAL_DETAIL = "Credential element kept a value."
SENSITIVE_DETAIL = "Sensitive element kept a value that is not redacted."
VISUAL_DETAIL = "Sensitive element whose visual scan failed."
TEXT_DETAIL = " pattern found in the payload."


def payload_elements(payload: str) -> str:
    """``context.elements``, else ``elements``, else none, as JSON strings.

    An unparsable payload yields no elements; its text is still scanned.
    """
    schema = "context struct<elements:array<string>>, elements array<string>"
    return let(
        "doc", f"from_json({payload}, '{schema}')",
        "coalesce(doc.context.elements, doc.elements, CAST(array() AS array<string>))",
    )


def _violation(category: str, element: str, index: str, detail: str) -> str:
    return (
        f"named_struct('category', {category}, 'elementId', {element}, "
        f"'index', {index}, 'detail', {detail})"
    )


def structural_violations(payload: str) -> str:
    """Credentials with a value key, sensitive values left open, failed visual scans."""
    credential = (
        "coalesce(el.type = 'password' OR el.category IN ('password', 'payment'), false)"
    )
    who = "coalesce(nullif(el.id, ''), nullif(el.selector, ''), 'unknown')"
    own = "nullif(el.category, '')"
    open_value = f"(el.value IS NOT NULL AND NOT {holds_placeholder('el.value')})"
    kept = _violation(
        f"coalesce({own}, if(cred, 'password', 'sensitive'))", who, "CAST(NULL AS INT)",
        f"if(cred, '{CREDENTIAL_DETAIL}', '{SENSITIVE_DETAIL}')",
    )
    failed = _violation(
        f"coalesce({own}, 'sensitive')", who, "CAST(NULL AS INT)", f"'{VISUAL_DETAIL}'"
    )
    none = f"CAST(array() AS array<{VIOLATION}>)"
    checks = (
        f"concat(if((cred AND has_value) OR (open AND {open_value}), array({kept}), {none}), "
        f"if(open AND coalesce(el.visualScanFailed, false), array({failed}), {none}))"
    )
    one = let(
        "el", f"from_json(raw, '{GATE_ELEMENT}')",
        let(
            "has_value", "coalesce(array_contains(json_object_keys(raw), 'value'), false)",
            let("cred", credential, let("open", "coalesce(el.sensitive, false)", checks)),
        ),
    )
    return f"flatten(transform({payload_elements(payload)}, raw -> {one}))"


def decoded(payload: str) -> str:
    """JSON text with its escapes undone, so that a value is seen as its receiver will see
    it, with its real neighbours. Quotes still separate one value from the next.

    Works on the text, parsable or not. ``\\uXXXX`` may stand for any letter, digit or
    separator; surrogates are joined in pairs, and one without its other half is a blank.
    """
    text = f"replace({payload}, r'\\\\', chr(0))"
    text = f"regexp_replace({text}, r'\\\\(?:[nrtbf]|u00[01][0-9a-fA-F])', ' ')"
    text = f"regexp_replace({text}, r'\\\\([\"/])', '$1')"
    unit = r"\\u(?:[0-9a-cA-CefEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2})"
    pair = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    # possessive: Java walks it in a loop, where a greedy one takes stack for every escape
    run = f"(?:{pair}|{unit})++"
    letters = f"decode(unhex(replace(u, r'\\u', '')), 'UTF-16BE')"
    joined = let(
        "t", text,
        f"array_join(zip_with(split(t, r'{run}', -1), regexp_extract_all(t, r'{run}', 0), "
        f"(p, u) -> concat(p, coalesce({letters}, ''))), '')",
    )
    text = f"if(contains({payload}, r'\\u'), {joined}, {text})"
    text = f"regexp_replace({text}, r'\\\\u[dD][89a-fA-F][0-9a-fA-F]{{2}}', ' ')"
    return f"replace({text}, chr(0), r'\\')"


# An escape of JSON text that ``decoded`` turns into one letter.
_ESCAPE = (
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[nrtbf\"/\\]"
)


def stored_places(payload: str, violations: str) -> str:
    """``violations`` with their places counted in ``payload`` as it is stored. Places found in
    its decoded form lie behind by what each escape before them is longer than its letter."""
    escapes = f"regexp_extract_all({payload}, r'{_ESCAPE}', 0)"
    gaps = f"split({payload}, r'{_ESCAPE}', -1)"
    steps = f"zip_with({gaps}, {escapes}, (g, e) -> struct(length(g) AS gap, length(e) AS size))"
    walked = (
        "aggregate(steps, named_struct('at', 0, 'more', 0), (s, x) -> named_struct("
        "'at', s.at + x.gap + 1, 'more', s.more + if(x.size IS NOT NULL AND s.at + x.gap < v.index, x.size - 1, 0)), "
        "s -> v.index + s.more)"
    )
    moved = "transform(found, v -> " + _violation("v.category", "v.elementId", f"if(v.index IS NULL, NULL, {walked})", "v.detail") + ")"
    return let("found", violations, f"if(size(found) = 0 OR NOT contains({payload}, r'\\'), found, {let('steps', steps, moved)})")


def text_violations(text: str, rules: Sequence[PiiRule] = GATE_RULES) -> str:
    """One violation per accepted match of each rule: category and place, never the value."""
    per_rule = [
        f"transform({match_positions(text, rule)}, m -> "
        + _violation(
            f"'{rule.category}'", "CAST(NULL AS STRING)", "m.start",
            f"'{rule.category}{TEXT_DETAIL}'",
        )
        + ")"
        for rule in rules
    ]
    return f"concat({', '.join(per_rule)})"


def gate(
    df: DataFrame,
    payload: str = "payload",
    mode: str = "decoded",
    rules: Sequence[PiiRule] = GATE_RULES,
    compat: bool = False,
) -> DataFrame:
    """Add ``blocked``, ``success``, ``reason``, ``violationsCount`` and ``violations``; a
    violation's ``index`` is its place in the payload as it is stored, from 0.

    ``mode='serialized'`` scans the JSON text as it stands; the default undoes escapes
    first. An empty payload is blocked unless ``compat`` is set.
    """
    if mode not in ("decoded", "serialized"):
        raise ValueError(f"unknown mode {mode!r}")
    scanned = decoded(payload) if mode == "decoded" else payload
    none = f"CAST(array() AS array<{VIOLATION}>)"
    empty = f"coalesce(length({payload}) = 0, true)"
    in_text = let("body", scanned, text_violations("body", rules))
    if mode == "decoded":
        in_text = stored_places(payload, in_text)
    found = f"if({empty}, {none}, concat({structural_violations(payload)}, {in_text}))"
    out = evaluate_once(df, violations=found)
    hit = F.size("violations") > 0
    blocked = hit if compat else (hit | F.expr(empty))
    return (
        out.withColumn("blocked", blocked)
        .withColumn("success", ~F.col("blocked"))
        .withColumn(
            "reason",
            F.when(hit, F.lit("privacy_violation")).when(
                F.col("blocked"), F.lit("empty_payload")
            ),
        )
        .withColumn("violationsCount", F.size("violations"))
    )


def split_gate(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantine). Quarantine keeps the verdict and drops the payload."""
    passed = gated.where(~F.col("blocked"))
    quarantine = gated.where(F.col("blocked")).drop("payload")
    return passed, quarantine


def violation_rows(gated: DataFrame, keys: list[str]) -> DataFrame:
    return gated.select(*keys, F.explode("violations").alias("v")).select(*keys, "v.*")


def violations_by_category(gated: DataFrame) -> DataFrame:
    return (
        gated.select(F.explode("violations.category").alias("category"))
        .groupBy("category").agg(F.count(F.lit(1)).alias("violations"))
    )
