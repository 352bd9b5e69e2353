"""When an image needs its text recognised."""

from __future__ import annotations

import re

from .text import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, let, literal

# Keywords, decorative tokens.
IMAGE_KEYWORDS = (
    "id card", "id_card", "identity", "license", "driving license", "passport", "aadhaar",
    "pan card", "pan_card", "document", "screenshot", "cheque", "passbook", "bank statement",
    "tax id", "ssn", "kyc", "verification doc", "id proof",
)
DECORATIVE_TOKENS = ("logo", "icon", "banner", "avatar", "placeholder", "badge", "decoration")

_ANY_SEPARATOR = f"[{SPACE}_-]+"
KEYWORD_PATTERN = (
    f"(?i){NOT_AFTER_WORD}(?:"
    + "|".join(_ANY_SEPARATOR.join(re.split("[ _]", k)) for k in IMAGE_KEYWORDS)
    + f"){NOT_BEFORE_WORD}"
)


def trigger(
    tag: str, type_: str, alt: str = "''", label: str = "''", text: str = "''",
    name: str = "''", class_name: str = "''", role: str = "''", aria_hidden: str = "''",
    is_form: str = "false",
) -> str:
    """struct(trigger, reason, categoryHint); every argument is SQL text.

    The order of the tests matters: a keyword outranks a decorative token.
    """
    def trimmed(x: str) -> str:
        return f"coalesce(trim({x}), '')"

    def verdict(on: str, reason: str, hint: str = "CAST(NULL AS STRING)") -> str:
        return f"named_struct('trigger', {on}, 'reason', {reason}, 'categoryHint', {hint})"

    keyword = f"regexp_extract(ctx, {literal(KEYWORD_PATTERN)}, 0)"
    decorative = " OR ".join(f"contains(ctx, '{t}')" for t in DECORATIVE_TOKENS)
    context = (
        f"lower(concat_ws(' ', {trimmed(alt)}, {trimmed(label)}, {trimmed(text)}, "
        f"coalesce({name}, ''), coalesce({class_name}, '')))"
    )
    shown_alt = f"coalesce(nullif({trimmed(alt)}, ''), lower(coalesce({class_name}, '')))"
    image = let("ctx", context, let("kw", keyword, f"""CASE
WHEN lower(coalesce({role}, '')) IN ('presentation', 'none') OR coalesce({aria_hidden}, '') = 'true'
  THEN {verdict('false', "'decorative by role'")}
WHEN kw <> '' THEN {verdict('true', "concat('keyword: ', kw)", "'id_document'")}
WHEN {decorative} THEN {verdict('false', f"concat('decorative: ', {shown_alt})")}
WHEN {trimmed(alt)} = '' AND {trimmed(label)} = '' AND {is_form}
  THEN {verdict('true', "'unlabeled image on a form page'", "'unlabeled_image'")}
ELSE {verdict('false', f"concat('no match: ', coalesce(nullif({trimmed(alt)}, ''), 'none'))")} END"""))
    return f"""CASE
WHEN {tag} IS NULL AND {type_} IS NULL THEN {verdict('false', "'no element'")}
WHEN lower({tag}) <=> 'canvas' OR lower({type_}) <=> 'canvas'
  THEN {verdict('true', "'canvas'", "'canvas_document'")}
WHEN lower({tag}) <=> 'img' OR lower({type_}) <=> 'image' THEN {image}
ELSE {verdict('false', f"concat('explained by its text: ', lower(coalesce({tag}, '')))")} END"""
