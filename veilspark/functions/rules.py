"""The ordered detection rules.

A rule is data: a category, a pattern, an optional validator and a cheap necessary
condition. The order of the list is part of the result, since each rule reads the
text that the one before it left. Patterns are written for Java's engine: every one
starts with a first-character test so that most positions fail at once, and word
boundaries are spelled out for ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from .text import (
    ALNUM,
    BOUNDARY,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    PREFIXES,
    SPACE,
    WORD,
    literal,
    luhn_valid,
)


@dataclass(frozen=True)
class PiiRule:
    """One detection rule.

    ``keeps_label``: group 1 of the pattern is a label that stays in the text; the
    value is the rest of the match. ``necessary`` and ``validate`` turn SQL text into
    SQL text: the first is true wherever the pattern can match, the second decides on
    one raw match.
    """

    category: str
    pattern: str
    confidence: float
    necessary: Callable[[str], str]
    validate: Callable[[str], str] | None = None
    keeps_label: bool = False

    @property
    def prefix(self) -> str:
        return PREFIXES.get(self.category, self.category.upper() or "REDACTED")


def _like(pattern: str) -> Callable[[str], str]:
    return lambda text: f"rlike({text}, {literal(pattern)})"


def _any_of(*needles: str) -> Callable[[str], str]:
    return lambda text: "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


# nine digits or more, with nothing but separators between them
_long_digit_run = _like(f"[0-9][0-9{SPACE}().+-]{{8}}")


# Patterns, labels and honorifics.
CARD = (
    f"(?=[0-9]){NOT_AFTER_WORD}"
    f"(?:(?:[0-9]{{4}}[{SPACE}-]+){{3}}|(?:[0-9]{{4}}[{SPACE}-]?){{3}})[0-9]{{4}}{NOT_BEFORE_WORD}"
)
AADHAAR = (
    f"(?=[2-9]){NOT_AFTER_WORD}"
    f"[2-9](?:[0-9]{{3}}[{SPACE}-]+[0-9]{{4}}[{SPACE}-]+[0-9]{{4}}|[0-9]{{11}}){NOT_BEFORE_WORD}"
)
_SEP = f"[{SPACE}.-]"
_PHONE_UK = f"\\+44{_SEP}*(?:[0-9]{_SEP}*){{9,10}}{BOUNDARY}"
_PHONE_INDIA = (
    f"(?:(?<=[{WORD}])\\+91{_SEP}*|{NOT_AFTER_WORD}(?:0{_SEP}*)?)"
    f"[6-9](?:[0-9]{{4}}{_SEP}+[0-9]{{5}}|[0-9]{{2}}{_SEP}+[0-9]{{3}}{_SEP}+[0-9]{{4}}|[0-9]{{9}})"
    f"{NOT_BEFORE_WORD}"
)
_PHONE_NANP = (
    f"(?:\\+1{_SEP}*)?\\(?[0-9]{{3}}\\)?{_SEP}*[0-9]{{3}}{_SEP}+[0-9]{{4}}{NOT_BEFORE_WORD}"
)
PHONE = f"(?=[+(0-9])(?:{_PHONE_UK}|{_PHONE_INDIA}|{_PHONE_NANP})"
# The local part is taken to the end of its run, so only the start of the run, or of what an
# earlier match left of it, is tried: other starts fail in the same place.
_LOCAL = f"[{ALNUM}._%+-]"
EMAIL = f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[{ALNUM}.-]+\\.[a-zA-Z]{{2,}}"
PAN = f"(?=[A-Z]){NOT_AFTER_WORD}[A-Z]{{5}}[0-9]{{4}}[A-Z]{NOT_BEFORE_WORD}"

NAME_LABELS = ("name", "applicant", "customer", f"account[{SPACE}]+holder")
HONORIFICS = ("Mr\\.", "Mrs\\.", "Ms\\.", "Dr\\.")
_LABEL_SEP = f"[{SPACE}:–-]"
_FULL_NAME = f"[A-Z][a-z]+(?:[{SPACE}]+[A-Z][a-z]+){{1,2}}{NOT_BEFORE_WORD}"
NAME = (
    f"({NOT_AFTER_WORD}(?:{'|'.join(NAME_LABELS)}){_LABEL_SEP}+){_FULL_NAME}"
    f"|{NOT_AFTER_WORD}(?:{'|'.join(HONORIFICS)})[{SPACE}]+{_FULL_NAME}"
)

# Place words; the last two count after a label only.
PLACE_WORDS = (
    "Street", "St", "Avenue", "Ave", "Road", "Rd", "Block", "Sector", "Park", "Nagar",
    "Lane", "Drive", "Dr", "Floor", "Apt", "Suite", "Building", "Delhi", "Mumbai",
    "Bangalore", "Bengaluru", "Kolkata", "Chennai", "Hyderabad", "Pune", "India",
)
LABELLED_PLACE_WORDS = ("USA", "UK")


def _places(words: tuple[str, ...]) -> str:
    """One of ``words``; where none of their first letters stands, none is tried."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(words)})"


_PLACE = _places(PLACE_WORDS)
_PLACE_AFTER_LABEL = _places(PLACE_WORDS + LABELLED_PLACE_WORDS)
_RUN = f"[{ALNUM}{SPACE},.-]"
# The label is kept group 1, with any number of separators. Where an earlier match has
# swallowed it, it can only be looked back at, and Java bounds that: by 40 separators.
_ADDRESS_LABEL = f"{NOT_AFTER_WORD}(?:address|residence){_LABEL_SEP}"
_AFTER_ADDRESS_LABEL = (
    f"(?:({_ADDRESS_LABEL}+?)|(?<={_LABEL_SEP})(?<={_ADDRESS_LABEL}{{1,40}}))"
)


def _address(place_start: str) -> str:
    labelled = (
        f"{_AFTER_ADDRESS_LABEL}{_RUN}+{BOUNDARY}{_PLACE_AFTER_LABEL}{NOT_BEFORE_WORD}{_RUN}*"
    )
    numbered = (
        f"(?=[0-9]){NOT_AFTER_WORD}[0-9]{{1,5}}[{SPACE}]+{_RUN}+"
        f"{place_start}{_PLACE}{NOT_BEFORE_WORD}{_RUN}*"
    )
    return f"(?i)(?:{labelled}|{numbered})"


ADDRESS = _address("")
STRICT_ADDRESS = _address(BOUNDARY)


_address_possible = _like(f"[0-9][{SPACE}]|(?i:address|residence)")


RULES: tuple[PiiRule, ...] = (
    PiiRule("card", CARD, 1.0, _long_digit_run, validate=luhn_valid),
    PiiRule("aadhaar", AADHAAR, 1.0, _long_digit_run),
    PiiRule("phone", PHONE, 1.0, _long_digit_run),
    PiiRule("email", EMAIL, 1.0, _any_of("@")),
    PiiRule("pan", PAN, 1.0, _like("[A-Z]{5}[0-9]{4}[A-Z]")),
    PiiRule(
        "name", NAME, 0.7,
        _any_of("name", "applicant", "customer", "holder", "Mr.", "Mrs.", "Ms.", "Dr."),
        keeps_label=True,
    ),
    PiiRule("address", ADDRESS, 0.7, _address_possible, keeps_label=True),
)

# The gate looks for the five checkable categories only, in its own order.
GATE_CATEGORIES = ("card", "aadhaar", "pan", "phone", "email")
GATE_RULES: tuple[PiiRule, ...] = tuple(
    next(r for r in RULES if r.category == c) for c in GATE_CATEGORIES
)


def rules_with(strict_address: bool = False) -> tuple[PiiRule, ...]:
    """The default rules; ``strict_address`` makes a place word start at a word start,
    so that prose such as "3 of the best items" is left alone."""
    if not strict_address:
        return RULES
    return tuple(
        replace(r, pattern=STRICT_ADDRESS)
        if r.category == "address" else r
        for r in RULES
    )
