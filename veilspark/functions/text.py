"""Small string helpers shared by every operator.

The functions of this package take and return Spark SQL text. One ``F.expr`` per query
then builds the whole expression: putting thousands of nested column objects together
call by call would take longer than many of the queries.
"""

from __future__ import annotations

import string

# The characters that count as white space, and as word characters,
# in the rules. Java's \s and \b differ from these, so patterns spell them out. All are what
# stands between the brackets of a class. Java tests single letters of Latin-1 by one look
# into a table, and each range by a call of its own; so letters are listed one by one, and
# SPACE, which is WS in Java's syntax, asks for other white space beyond Latin-1 only.
_LATIN_WS = r"\t\n\x0b\f\r \xa0"
_OTHER_WS = (
    r"\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
WS = _LATIN_WS + _OTHER_WS
SPACE = _LATIN_WS + rf"[\x{{100}}-\x{{ffff}}&&[{_OTHER_WS}]]"
ALNUM = string.ascii_letters + string.digits
WORD = ALNUM + "_"

NOT_AFTER_WORD = f"(?<![{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Category to placeholder prefix.
PREFIXES = {
    "email": "EMAIL",
    "phone": "PHONE",
    "name": "PERSON",
    "person": "PERSON",
    "card": "CARD",
    "payment": "CARD",
    "address": "ADDRESS",
    "password": "PASSWORD",
    "sensitive": "PASSWORD",
    "pan": "PAN",
    "aadhaar": "AADHAAR",
}
PLACEHOLDER_PREFIXES = (
    "EMAIL", "PHONE", "PERSON", "CARD", "ADDRESS", "PASSWORD", "PAN", "AADHAAR",
)
LEGACY_MARK = "[REDACTED:"




def literal(text: str) -> str:
    """A raw SQL string literal: patterns go in as they are."""
    if "'" in text:
        raise ValueError("quotes are not supported in patterns")
    return f"r'{text}'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it in ``body`` as ``name``.

    Without this, an expression used twice is also planned twice, and a chain of
    rules would double in size at every rule. The aggregate has nothing to add up: its
    start value is bound to the name that the final step uses.
    """
    return f"aggregate(array(), {value}, (acc, x) -> acc, {name} -> {body})"


def strip(text: str) -> str:
    """Trim with the wide white-space class (``trim`` removes spaces only)."""
    pattern = literal(f"^[{SPACE}]+|[{SPACE}]+\\z")
    return f"regexp_replace({text}, {pattern}, '')"


def collapse(text: str) -> str:
    pattern = literal(f"[{SPACE}]+")
    return f"regexp_replace({text}, {pattern}, ' ')"


def is_blank(text: str) -> str:
    pattern = literal(f"[^{WS}]")
    return f"(NOT coalesce(rlike({text}, {pattern}), false))"


def luhn_valid(text: str) -> str:
    """13 to 19 digits, separators ignored, with a correct check digit; null is not valid."""
    digits = f"regexp_replace({text}, '[^0-9]', '')"
    return f"coalesce(length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits}), false)"


def normalise_key(category: str, raw: str) -> str:
    """The form in which two raw values of one category count as the same value."""
    category, val = category.lower(), strip(raw)
    if category == "email":
        return f"lower({val})"
    if category in ("phone", "card", "payment", "aadhaar"):
        separators = literal(f"[{SPACE}.-]")
        return f"regexp_replace({val}, {separators}, '')"
    if category == "pan":
        return f"upper({val})"
    return collapse(val)


def normalise_key_of(category: str, raw: str) -> str:
    """As above, for a category that is itself a column."""
    return (
        f"CASE lower({category}) WHEN 'email' THEN {normalise_key('email', raw)} "
        f"WHEN 'pan' THEN {normalise_key('pan', raw)} "
        + " ".join(
            f"WHEN '{c}' THEN {normalise_key(c, raw)}"
            for c in ("phone", "card", "payment", "aadhaar")
        )
        + f" ELSE {normalise_key('', raw)} END"
    )


def prefix_of(category: str) -> str:
    arms = " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in PREFIXES.items())
    other = f"coalesce(nullif(upper({category}), ''), 'REDACTED')"
    return f"CASE lower({category}) {arms} ELSE {other} END"


_NAMES = "|".join(PLACEHOLDER_PREFIXES)


def is_placeholder(value: str, tail: str = "[0-9]+") -> str:
    """The whole value is one placeholder, or it holds a legacy mark."""
    whole = literal(f"(?i)^(?:{_NAMES})_(?:{tail})\\z")
    return f"coalesce(rlike({value}, {whole}) OR contains({value}, '{LEGACY_MARK}'), false)"


def holds_placeholder(value: str) -> str:
    """The gate's wider test: a placeholder anywhere in the value is enough."""
    inside = literal(f"{NOT_AFTER_WORD}(?:{_NAMES})_[0-9]+{NOT_BEFORE_WORD}")
    return f"({is_placeholder(value)} OR coalesce(rlike({value}, {inside}), false))"
