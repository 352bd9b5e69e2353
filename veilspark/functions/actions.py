"""Checks of one structured action, as SQL text. A reason is null where the check holds."""

from __future__ import annotations

from .text import let, literal

# The action types and the id format.
ACTION_TYPES = ("CLICK", "TYPE", "SELECT", "CHECK", "UNCHECK", "SCROLL", "NAVIGATE", "WAIT")
DONE = "DONE"
TARGET_ID = r"(?i)^el_[0-9]+\z"
NON_TEXT_INPUTS = ("button", "submit", "reset", "image", "checkbox", "radio", "file", "hidden")
CLICK_INPUTS = ("button", "submit", "reset", "image")
CLICK_ROLES = ("button", "link", "menuitem", "tab")
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def is_allowed(action: str) -> str:
    return f"coalesce(upper({action}) IN {ACTION_TYPES}, false)"


def is_completion(action: str) -> str:
    return f"coalesce(upper({action}) = '{DONE}', false)"


def schema_reason(action: str, target: str, value: str, is_object: str = "true") -> str:
    """The first schema rule that is broken."""
    kind = f"upper({action})"
    return f"""CASE
WHEN NOT {is_object} THEN 'not an object'
WHEN {is_completion(action)} THEN NULL
WHEN NOT {is_allowed(action)} THEN concat('unsupported action ', coalesce({action}, 'null'))
WHEN {kind} NOT IN ('NAVIGATE', 'WAIT') AND coalesce({target}, '') = '' THEN concat({kind}, ' needs a target')
WHEN {kind} NOT IN ('NAVIGATE', 'WAIT') AND NOT rlike(trim({target}), {literal(TARGET_ID)})
  THEN concat('bad target format ', {target})
WHEN {kind} IN ('TYPE', 'SELECT') AND {value} IS NULL THEN concat({kind}, ' needs a value')
WHEN {kind} = 'NAVIGATE' AND coalesce({value}, '') = '' THEN 'NAVIGATE needs a URL'
END"""


def _parts(url: str) -> str:
    """struct(scheme, host, port) of an absolute URL; lower case, default ports filled in."""
    scheme = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    authority = (
        rf"regexp_replace(regexp_extract({url}, "
        r"r'^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*([^/\\?#]*)', 1), '^.*@', '')"
    )
    port = r"regexp_extract(auth, r':([^:\]]*)$', 1)"
    ports = " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in DEFAULT_PORTS.items())
    fields = (
        "named_struct('scheme', scheme, 'host', lower(regexp_replace(auth, ':[0-9]*$', '')), "
        f"'port', coalesce(nullif({port}, ''), CASE scheme {ports} ELSE '' END))"
    )
    return let("scheme", scheme, let("auth", authority, fields))


def navigate_reason(value: str, current: str, compat: bool = False) -> str:
    """Same origin, or file to file. A relative address has the origin of its page.

    Without a current address, and between two opaque origins, the answer is no;
    ``compat`` lets both through.
    """
    special = "('http', 'https', 'ws', 'wss', 'ftp')"
    clean = f"trim({value})"
    relative = f"NOT rlike({clean}, '^[A-Za-z][A-Za-z0-9+.-]*:')"
    absolute = (
        f"CASE WHEN {relative} AND NOT startswith({clean}, '//') THEN {current} "
        f"WHEN {relative} THEN concat(regexp_extract({current}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1), {clean}) "
        f"ELSE {clean} END"
    )
    malformed = (
        f"(to.scheme IN {special} AND (to.host = '' OR rlike(to.host, {literal('[ <>^|%\\[\\]]')}) "
        "OR NOT rlike(to.port, '^[0-9]{1,5}$') OR try_cast(to.port AS INT) > 65535))"
    )
    no_page = "NULL" if compat else "'no current page to compare with'"
    opaque = "NULL" if compat else "concat('cross-origin ', url)"
    same = "to.scheme = here.scheme AND to.host = here.host AND to.port = here.port"
    checks = f"""CASE
WHEN coalesce({current}, '') = '' AND {relative} THEN {no_page}
WHEN {malformed} THEN concat('malformed URL ', url)
WHEN coalesce({current}, '') = '' THEN {no_page}
WHEN to.scheme = 'file' AND here.scheme = 'file' THEN NULL
WHEN to.scheme IN {special} AND {same} THEN NULL
WHEN to.scheme NOT IN {special} AND here.scheme NOT IN {special} THEN {opaque}
ELSE concat('cross-origin ', url) END"""
    return let(
        "url", value,
        let("to", _parts(f"coalesce({absolute}, '')"),
            let("here", _parts(f"coalesce({current}, '')"), checks)),
    )


def compatibility_reason(action: str, tag: str, role: str, input_type: str) -> str:
    """Which controls an action may be aimed at."""
    tag, role, kind = (f"lower(coalesce({x}, ''))" for x in (tag, role, input_type))
    return f"""CASE upper({action})
WHEN 'CLICK' THEN CASE WHEN NOT ({tag} IN ('button', 'a') OR ({tag} = 'input' AND {kind} IN {CLICK_INPUTS})
  OR {role} IN {CLICK_ROLES}) THEN concat('not clickable: ', {tag}) END
WHEN 'TYPE' THEN CASE WHEN NOT ({tag} = 'textarea' OR ({tag} = 'input' AND {kind} NOT IN {NON_TEXT_INPUTS}))
  THEN concat('not a text control: ', {tag}) END
WHEN 'SELECT' THEN CASE WHEN {tag} <> 'select' THEN concat('not a select: ', {tag}) END
WHEN 'CHECK' THEN CASE WHEN NOT (({tag} = 'input' AND {kind} IN ('checkbox', 'radio'))
  OR {role} IN ('checkbox', 'radio')) THEN concat('not checkable: ', {tag}) END
WHEN 'UNCHECK' THEN CASE WHEN NOT (({tag} = 'input' AND {kind} IN ('checkbox', 'radio'))
  OR {role} IN ('checkbox', 'radio')) THEN concat('not checkable: ', {tag}) END
END"""


def planned_action(response: str) -> str:
    """struct(is_object, action, target, value, reason) from a planner's JSON response.

    Either an object under ``action``, or the same fields side by side. Anything else is
    not an action object.
    """
    flat = "action string, target string, value string, reason string"
    nested = f"from_json(r.action, '{flat}')"
    return let(
        "r", f"from_json({response}, '{flat}')",
        f"""CASE
WHEN startswith(ltrim(r.action), '{{') THEN {let('a', nested, "named_struct('is_object', true, 'action', a.action, 'target', a.target, 'value', a.value, 'reason', a.reason)")}
WHEN r.action IS NOT NULL AND coalesce(r.target, '') <> ''
  THEN named_struct('is_object', true, 'action', r.action, 'target', r.target, 'value', r.value, 'reason', r.reason)
WHEN r.action IS NOT NULL
  THEN named_struct('is_object', false, 'action', r.action, 'target', CAST(NULL AS STRING), 'value', CAST(NULL AS STRING), 'reason', CAST(NULL AS STRING))
ELSE named_struct('is_object', startswith(ltrim({response}), '{{'), 'action', CAST(NULL AS STRING),
  'target', r.target, 'value', r.value, 'reason', r.reason) END""",
    )


def action_summary(action: str, target: str) -> str:
    return f"trim(concat_ws(' ', {action}, {target}))"
