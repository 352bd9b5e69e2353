"""Per-element sanitisation of a scan that is held as one row.

Input rows have ``elements``, an array of ``ELEMENT`` structs in scan order. The whole
step is one narrow projection: folding, field heuristics, numbering and the log are
array expressions over the row, so there is no shuffle whatever the number of scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import NO_EVENTS, TOKEN, event, redact, token_of
from ..functions.rules import RULES, PiiRule
from ..functions.text import (
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    SPACE,
    is_blank,
    is_placeholder,
    let,
    literal,
    normalise_key,
    prefix_of,
    strip,
)
from .numbering import evaluate_once, fill_numbers, known_prefixes, number_in, token_lists

ELEMENT = (
    "struct<id:string,tag:string,type:string,label:string,text:string,name:string,"
    "category:string,value:string,has_value:boolean,sensitive:boolean,selector:string,"
    "alt:string,visionTriggered:boolean,visionReason:string,visualScanFailed:boolean>"
)
ELEMENT_FIELDS = tuple(f.split(":")[0] for f in ELEMENT[len("struct<"):-1].split(","))
REDACTION = (
    "struct<id:string,category:string,confidence:double,source:string,"
    "placeholder:string,selector:string>"
)

# Form tags and the field words of the two heuristics.
FORM_TAGS = ("input", "textarea", "select")
NAME_FIELD = f"(?i){NOT_AFTER_WORD}(?:full[-_]?name|name){NOT_BEFORE_WORD}"
ADDRESS_FIELD = f"(?i){NOT_AFTER_WORD}(?:address|residence|street){NOT_BEFORE_WORD}"
PERSON_VALUE = f"^[A-Z][a-z]+(?:[{SPACE}]+[A-Z][a-z]+){{1,3}}\\z"


def target_of(e: str = "") -> str:
    """id, else selector, else ``unknown``; ``e`` is the element's name and a dot."""
    return f"coalesce(nullif({e}id, ''), nullif({e}selector, ''), 'unknown')"


def _heuristics(value: str) -> str:
    """Name and address fields: struct(value, events) for a form value after the fold."""
    meta = "concat_ws(' ', coalesce(e.label, ''), coalesce(e.name, ''), coalesce(e.selector, ''))"

    def still_open(v: str) -> str:
        return f"NOT {is_blank(v)} AND NOT {is_placeholder(v, f'[0-9]+|{TOKEN}')}"

    def taken(prefix: str, category: str, v: str, before: str) -> str:
        replaced = (
            f"named_struct('value', concat('{prefix}_', tk), 'events', concat({before}, "
            f"array({event(repr(category), repr(prefix), 'tk', 0.7)})))"
        )
        return let("tk", token_of(repr(prefix), normalise_key(category, v)), replaced)

    person = (
        f"{still_open(value)} AND rlike(meta, {literal(NAME_FIELD)}) "
        f"AND rlike({strip(value)}, {literal(PERSON_VALUE)})"
    )
    place = (
        f"{still_open('named.value')} AND rlike(meta, {literal(ADDRESS_FIELD)}) "
        "AND NOT contains(lower(meta), 'email')"
    )
    plain = f"named_struct('value', {value}, 'events', {NO_EVENTS})"
    named = f"if({person}, {taken('PERSON', 'name', value, NO_EVENTS)}, {plain})"
    address = taken("ADDRESS", "address", "named.value", "named.events")
    return let("meta", meta, let("named", named, f"if({place}, {address}, named)"))


def _fold_element(rules: Sequence[PiiRule]) -> str:
    """struct(text, value, events, purged) of element ``e`` at index ``i``, unnumbered."""
    form = f"coalesce(e.tag IN {FORM_TAGS}, false)"
    category = (
        "coalesce(nullif(e.category, ''), if(e.type <=> 'password', 'password', 'sensitive'))"
    )
    # numbered per instance: the key is the element's place, not a value
    instance = "concat(chr(1), CAST(i AS STRING))"
    purge = let(
        "px", prefix_of(category),
        let(
            "tk", token_of("px", instance),
            "named_struct('text', if(e.text IS NULL, NULL, concat(px, '_', tk)), "
            "'value', CAST(NULL AS STRING), "
            f"'events', array({event(category, 'px', 'tk', 1.0)}), 'purged', true)",
        ),
    )
    # form controls: the value only; anything else: the text, then a stray value
    parts = (
        f"transform(array(named_struct('t', e.text, 'on', NOT {form}), "
        "named_struct('t', e.value, 'on', true)), part -> "
        f"if(part.on AND NOT {is_blank('part.t')}, {redact('part.t', rules)}, "
        f"named_struct('text', part.t, 'events', {NO_EVENTS})))"
    )
    no_field = f"named_struct('value', folded[1].text, 'events', {NO_EVENTS})"
    scanned = let(
        "folded", parts,
        let(
            "field",
            f"if({form} AND coalesce(length(e.value) > 0, false), "
            f"{_heuristics('folded[1].text')}, {no_field})",
            "named_struct('text', folded[0].text, 'value', field.value, "
            "'events', concat(folded[0].events, folded[1].events, field.events), 'purged', false)",
        ),
    )
    return f"if(coalesce(e.sensitive, false), {purge}, {scanned})"


def sanitize_scans(
    df: DataFrame,
    elements: str = "elements",
    rules: Sequence[PiiRule] = RULES,
    keep_registry: bool = False,
) -> DataFrame:
    """Replace ``elements`` by their sanitised form and add ``redactions``.

    ``redactions`` is the value-free log: the first entry per (target, category).
    A missing element list counts as empty. ``totalElements`` is recomputed.
    ``keep_registry`` adds the scan's tokens per prefix, in number order, for a vision
    stage that goes on counting; it holds digests only and is dropped by that stage.
    """
    prefixes = known_prefixes(tuple(r.prefix for r in rules))
    source = f"coalesce({elements}, CAST(array() AS array<{ELEMENT}>))"
    folded = evaluate_once(
        df,
        _els=f"transform({source}, (e, i) -> named_struct('e', e, 'f', {_fold_element(rules)}))",
    )
    events = (
        "flatten(transform(_els, x -> transform(x.f.events, v -> named_struct("
        f"'target', {target_of('x.e.')}, 'selector', x.e.selector, 'category', v.category, "
        "'prefix', v.prefix, 'token', v.token, 'confidence', v.confidence))))"
    )
    listed = evaluate_once(
        evaluate_once(folded, _events=events), _lists=token_lists("_events", prefixes)
    )

    def number(token: str) -> str:
        # the last resort is for prefixes made from an element's own category
        mine = f"get(filter(_events, o -> o.token = {token}), 0).prefix"
        own = (
            f"nullif(array_position(array_distinct(transform(filter(_events, o -> "
            f"o.prefix = {mine}), o -> o.token)), {token}), 0)"
        )
        return number_in("_lists", token, prefixes, own)

    new = {
        "text": fill_numbers("x.f.text", number("tok")),
        "value": fill_numbers("x.f.value", number("tok")),
        "has_value": "coalesce(x.e.has_value, false) AND NOT x.f.purged",
        "sensitive": "coalesce(x.e.sensitive, false) OR size(x.f.events) > 0",
    }
    fields = ", ".join(f"'{n}', {new.get(n, 'x.e.' + n)}" for n in ELEMENT_FIELDS)
    log = (
        "transform(_events, v -> named_struct('id', v.target, 'category', v.category, "
        "'confidence', v.confidence, 'source', 'dom', 'placeholder', "
        f"concat(v.prefix, '_', CAST({number('v.token')} AS STRING)), 'selector', v.selector))"
    )
    first = let(
        "log", log,
        let(
            "keys", "transform(log, r -> concat_ws('::', r.id, r.category))",
            "filter(log, (r, i) -> array_position(keys, keys[i]) = i + 1)",
        ),
    )
    done = evaluate_once(
        listed, _done=f"transform(_els, x -> named_struct({fields}))", redactions=first
    )
    others = [c for c in df.columns if c not in (elements, "redactions", "totalElements")]
    private = [F.col("_lists").alias("registry")] if keep_registry else []
    return done.select(
        *others, F.col("_done").alias(elements), "redactions",
        F.size("_done").alias("totalElements"), *private,
    )


def with_envelope_defaults(df: DataFrame) -> DataFrame:
    """Missing url and title become empty, a missing time becomes now."""
    return (
        df.withColumn("url", F.coalesce("url", F.lit("")))
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("extractedAt", F.coalesce("extractedAt", F.current_timestamp()))
    )


def redaction_log(df: DataFrame, scan: list[str]) -> DataFrame:
    """One row per log entry; ``log_no`` keeps the order inside a scan."""
    return df.select(*scan, F.posexplode("redactions").alias("log_no", "_r")).select(
        *scan, "log_no", "_r.id", "_r.category", "_r.confidence", "_r.source", "_r.placeholder"
    )


def log_counts(log: DataFrame, scan: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Entries and distinct scans by category, confidence and source.

    Rows without a scan key are one scan, as in ``collect_elements``. A log that is dealt
    out by its scans is counted per scan where it stands; a few rows a task are shuffled.
    """
    kind = ["category", "confidence", "source"]
    per_scan = log.groupBy(*kind, *scan).agg(F.count(F.lit(1)).alias("_n"))
    return per_scan.groupBy(*kind).agg(
        F.sum("_n").alias("entries"), F.count(F.lit(1)).alias("scans")
    )


def collect_elements(rows: DataFrame, scan: list[str], position: str) -> DataFrame:
    """Element rows to one row per scan. Only for scans of bounded size (the element
    cap): a page has at most 200 elements."""
    present = set(rows.columns)
    types = dict(f.split(":") for f in ELEMENT[len("struct<"):-1].split(","))
    fields = [
        (F.col(n) if n in present else F.lit(None)).cast(types[n]).alias(n)
        for n in ELEMENT_FIELDS
    ]
    packed = F.sort_array(F.collect_list(F.struct(F.col(position).alias("_p"), F.struct(*fields).alias("e"))))
    return rows.groupBy(*scan).agg(
        F.transform(packed, lambda x: x["e"]).cast(f"array<{ELEMENT}>").alias("elements")
    )
