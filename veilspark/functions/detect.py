"""Matching, the ordered redaction fold, and match positions, as SQL expressions.

The fold replaces each accepted value by ``PREFIX_`` plus a *token*: forty letters
derived from a digest of the normalised value. The token depends on the value alone,
so equal values in any row, task or retry get equal tokens without any exchange of
data, and neither events nor shuffles carry raw values. The numbering operators later
turn tokens into the numbers 1, 2, 3 … of a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from .rules import RULES, PiiRule
from .text import let, literal, normalise_key

TOKEN_LENGTH = 40
TOKEN = f"[a-p]{{{TOKEN_LENGTH}}}"
EVENTS = "array<struct<category:string,prefix:string,token:string,confidence:double>>"
MARK = "chr(1)"
NO_EVENTS = f"CAST(array() AS {EVENTS})"


def token_of(prefix: str, key: str) -> str:
    """Forty letters a-p for one (prefix, normalised value); both are SQL text.

    Letters only: a token has no digits or separators, so it can never become part of
    a later digit rule, and it joins an e-mail local part just as a placeholder would.
    """
    digest = f"substr(sha2(concat({prefix}, '::', {key}), 256), 1, {TOKEN_LENGTH})"
    return f"translate({digest}, '0123456789', 'ghijklmnop')"


def event(category: str, prefix: str, token: str, confidence: float) -> str:
    """One event; all but the confidence are SQL text."""
    return (
        f"named_struct('category', {category}, 'prefix', {prefix}, 'token', {token}, "
        f"'confidence', {confidence}D)"
    )


def candidates(text: str, rule: PiiRule) -> str:
    """Every pattern match in ``text``, as struct(label, raw), before validation."""
    pattern = literal(rule.pattern)
    whole = f"regexp_extract_all({text}, {pattern}, 0)"
    if rule.keeps_label:
        labels = f"regexp_extract_all({text}, {pattern}, 1)"
        found = (
            f"zip_with({whole}, {labels}, (m, l) -> "
            "named_struct('label', l, 'raw', substr(m, length(l) + 1)))"
        )
    else:
        found = f"transform({whole}, m -> named_struct('label', '', 'raw', m))"
    none = "CAST(array() AS array<struct<label:string,raw:string>>)"
    return f"if({rule.necessary(text)}, {found}, {none})"


def matches(text: str, rule: PiiRule) -> str:
    """Accepted raw values of one rule in ``text``, in order."""
    raws = f"transform({candidates(text, rule)}, c -> c.raw)"
    return f"filter({raws}, r -> {rule.validate('r')})" if rule.validate else raws


def scanned(text: str, rule: PiiRule) -> str:
    """struct(gaps, hits): the parts of ``text`` between matches, one more than there are
    matches, and the matches as struct(label, raw) before validation; null without any.

    One pass: ``regexp_replace`` puts a mark around each match (and its label), and what is
    split there are gaps and matches in turn. ``split`` at a single character needs no pattern.
    Texts that hold the character already are taken apart by the pattern, twice.
    """
    pattern = literal(rule.pattern)
    groups = f"'$1', {MARK}, '$0'" if rule.keeps_label else "'$0'"
    parts = f"split(regexp_replace({text}, {pattern}, concat({MARK}, {groups}, {MARK})), {MARK}, -1)"
    if rule.keeps_label:
        gaps = "filter(parts, (p, i) -> i % 3 = 0)"
        hits = (
            "zip_with(filter(parts, (p, i) -> i % 3 = 1), filter(parts, (p, i) -> i % 3 = 2), "
            "(l, m) -> named_struct('label', l, 'raw', substr(m, length(l) + 1)))"
        )
    else:
        gaps = "filter(parts, (p, i) -> i % 2 = 0)"
        hits = "transform(filter(parts, (p, i) -> i % 2 = 1), m -> named_struct('label', '', 'raw', m))"
    once = let("parts", parts, f"if(size(parts) > 1, named_struct('gaps', {gaps}, 'hits', {hits}), NULL)")
    twice = let(
        "found", candidates(text, rule),
        f"if(size(found) > 0, named_struct('gaps', split({text}, {pattern}, -1), 'hits', found), NULL)",
    )
    return f"if({rule.necessary(text)}, if(contains({text}, {MARK}), {twice}, {once}), NULL)"


def match_positions(text: str, rule: PiiRule) -> str:
    """Accepted matches of one rule as struct(start, length); start counts from 0."""
    spans = (
        "zip_with(seen.gaps, seen.hits, (p, c) -> "
        "named_struct('gap', length(p), 'hit', c))"
    )
    out = "array<struct<start:int,length:int,ok:boolean>>"
    ok = rule.validate("x.hit.raw") if rule.validate else "true"
    begin = "acc.at + x.gap + coalesce(length(x.hit.label), 0)"
    size = "coalesce(length(x.hit.raw), 0)"
    entry = f"array(named_struct('start', {begin}, 'length', {size}, 'ok', {ok}))"
    walked = (
        f"aggregate({spans}, named_struct('at', 0, 'out', CAST(array() AS {out})), (acc, x) -> "
        f"named_struct('at', {begin} + {size}, 'out', "
        f"if(x.hit IS NULL, acc.out, concat(acc.out, {entry}))), acc -> acc.out)"
    )
    located = (
        f"transform(filter({walked}, e -> e.ok), "
        "e -> named_struct('start', e.start, 'length', e.length))"
    )
    none = "CAST(array() AS array<struct<start:int,length:int>>)"
    return let("seen", scanned(text, rule), f"if(seen IS NOT NULL, {located}, {none})")


def _apply_rule(state: str, rule: PiiRule) -> str:
    """The next state: ``state`` is the name of struct(text, events)."""
    token = token_of(f"'{rule.prefix}'", normalise_key(rule.category, "c.raw"))
    if rule.validate:
        token = f"CASE WHEN {rule.validate('c.raw')} THEN {token} END"
    hits = (
        "transform(seen.hits, c -> named_struct('label', c.label, 'raw', c.raw, "
        f"'token', {token}))"
    )
    text = (
        "array_join(zip_with(seen.gaps, hits, (p, h) -> "
        "concat(p, coalesce(concat(h.label, "
        f"if(h.token IS NOT NULL, concat('{rule.prefix}_', h.token), h.raw)), ''))), '')"
    )
    fresh = (
        "transform(filter(hits, h -> h.token IS NOT NULL), h -> "
        + event(f"'{rule.category}'", f"'{rule.prefix}'", "h.token", rule.confidence) + ")"
    )
    applied = let(
        "hits", hits,
        f"named_struct('text', {text}, 'events', concat({state}.events, {fresh}))",
    )
    return let("seen", scanned(f"{state}.text", rule), f"if(seen IS NULL, {state}, {applied})")


def can_match(text: str, rules: Sequence[PiiRule] = RULES) -> str:
    """False only where no rule can fire: substring tests and short patterns."""
    tests = " OR ".join(dict.fromkeys(r.necessary(text) for r in rules))
    return f"coalesce({tests or 'false'}, false)"


def redact(text: str, rules: Sequence[PiiRule] = RULES) -> str:
    """struct(text, events): ``text`` with tokens in place of personal data.

    Rules run in order, each over the text left by the one before. Texts on which no
    rule can fire pass through after a few cheap substring tests.
    """
    start = f"named_struct('text', {text}, 'events', {NO_EVENTS})"
    body = f"s{len(rules)}"
    for i in reversed(range(len(rules))):
        body = let(f"s{i + 1}", _apply_rule(f"s{i}", rules[i]), body)
    return f"if({can_match(text, rules)}, {let('s0', start, body)}, {start})"
