"""Recognised image text: lines, personal data in them, blackout rectangles, merging.

Input is the recogniser's result as JSON, one row per image. Everything stays in the
row until the results of a scan are brought together; a scan has at most 200 elements,
so that group is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import matches, token_of
from ..functions.rules import RULES, PiiRule
from ..functions.text import let, normalise_key, strip
from .numbering import evaluate_once, known_prefixes, number_in
from .sanitize import ELEMENT_FIELDS

BOX = "struct<x:int,y:int,width:int,height:int>"
_BBOX = "STRUCT<x0: INT, y0: INT, x1: INT, y1: INT>"
OCR_RESULT = (
    "text STRING, confidence DOUBLE, blocks ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<lines: "
    f"ARRAY<STRUCT<text: STRING, confidence: DOUBLE, bbox: {_BBOX}, "
    f"words: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, bbox: {_BBOX}>>>>>>>>"
)
# Padding, smallest labelled box, fallback box, shortest scanned line.
PAD_X, PAD_Y = 4, 2
LABEL_MIN_HEIGHT, LABEL_MIN_WIDTH = 14, 40
FALLBACK_BOX = "named_struct('x', 0, 'y', 0, 'width', 100, 'height', 40)"
MIN_LINE = 3


def _half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5D) AS INT)"


def _first_non_zero(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, 0D)" for x in xs) + ", 0D)"


def _box(b: str) -> str:
    x0, y0, x1, y1 = (f"coalesce({b}.{c}, 0)" for c in ("x0", "y0", "x1", "y1"))
    return (
        f"named_struct('x', {x0}, 'y', {y0}, 'width', greatest(0, {x1} - {x0}), "
        f"'height', greatest(0, {y1} - {y0}))"
    )


def flatten_ocr(df: DataFrame, result: str = "ocr") -> DataFrame:
    """Add ``lines`` and ``rawText``, ``ocrConfidence`` from a JSON result column.

    Blank lines are dropped; a page with text but no lines gives one line.
    """
    parsed = evaluate_once(df, _r=f"from_json({result}, '{OCR_RESULT}')")
    nested = (
        "flatten(flatten(transform(coalesce(_r.blocks, array()), b -> "
        "transform(coalesce(b.paragraphs, array()), p -> coalesce(p.lines, array())))))"
    )
    word = (
        f"named_struct('text', coalesce({strip('w.text')}, ''), "
        f"'confidence', {_half_up('coalesce(w.confidence, 0D)')}, 'boundingBox', {_box('w.bbox')})"
    )
    line = (
        f"named_struct('text', {strip('l.text')}, "
        f"'confidence', {_half_up(_first_non_zero('l.confidence', '_r.confidence'))}, "
        f"'boundingBox', {_box('l.bbox')}, "
        f"'words', transform(coalesce(l.words, array()), w -> {word}))"
    )
    lines = f"filter(transform({nested}, l -> {line}), x -> coalesce(x.text, '') <> '')"
    page_text = strip("_r.text")
    no_words = f"CAST(array() AS array<struct<text:string,confidence:int,boundingBox:{BOX}>>)"
    fallback = (
        f"array(named_struct('text', {page_text}, 'confidence', "
        f"{_half_up('coalesce(_r.confidence, 0D)')}, 'boundingBox', {FALLBACK_BOX}, 'words', {no_words}))"
    )
    with_lines = evaluate_once(
        parsed,
        lines=let("ls", lines, f"if(size(ls) = 0 AND coalesce({page_text}, '') <> '', {fallback}, ls)"),
    )
    return with_lines.selectExpr(
        *[f"`{c}`" for c in df.columns if c != result],
        "lines",
        "coalesce(nullif(_r.text, ''), array_join(transform(lines, l -> l.text), chr(10))) AS rawText",
        f"coalesce({_half_up('_r.confidence')}, get(lines, 0).confidence, 0) AS ocrConfidence",
    )


def ocr_line_rows(flat: DataFrame, keys: list[str]) -> DataFrame:
    return flat.select(*keys, F.posexplode("lines").alias("line_ord", "l")).select(
        *keys, "line_ord", "l.text", "l.confidence", "l.boundingBox", "l.words"
    )


def detect_visual(
    flat: DataFrame, lines: str = "lines", rules: Sequence[PiiRule] = RULES
) -> DataFrame:
    """Add ``instructions``: every match of every rule on every raw line, with the box
    of the first word that holds it or is held by it, else the line's."""
    def hits(rule: PiiRule) -> str:
        word = (
            "get(filter(l.words, w -> w.text <> '' AND (contains(m, w.text) OR contains(w.text, m))), 0)"
        )
        token = token_of(f"'{rule.prefix}'", normalise_key(rule.category, "m"))
        return (
            f"transform({matches('l.text', rule)}, m -> named_struct('line', li, "
            f"'category', '{rule.category}', 'confidence', {rule.confidence}D, "
            f"'prefix', '{rule.prefix}', 'token', {token}, 'raw_hash', sha2(m, 256), "
            f"'boundingBox', coalesce({word}.boundingBox, l.boundingBox)))"
        )

    per_line = f"concat({', '.join(hits(r) for r in rules)})"
    none = (
        "CAST(array() AS array<struct<line:int,category:string,confidence:double,prefix:string,"
        f"token:string,raw_hash:string,boundingBox:{BOX}>>)"
    )
    found = (
        f"flatten(transform({lines}, (l, li) -> if(length(l.text) < {MIN_LINE}, {none}, {per_line})))"
    )
    return evaluate_once(flat, instructions=found)


def merge_vision(
    scans: DataFrame, candidates: DataFrame, results: DataFrame, scan: str
) -> DataFrame:
    """Bring recognition results back to their scans.

    ``scans``: sanitised with ``keep_registry=True``. ``candidates``: (scan, element_id)
    that were to be recognised. ``results``: (scan, element_id, success, instructions).
    An element without a successful result is marked ``visualScanFailed``; one with
    findings becomes sensitive. Vision numbers go on where the page's numbers end.

    Both joins are sort-merge joins: all sides grow with the scans, and what is made from a
    short table looks small enough to the planner to be sent to every task.
    """
    outcome = candidates.select(scan, "element_id").join(
        results.select(scan, "element_id", "success", "instructions").hint("merge"), [scan, "element_id"], "left"
    )
    ok = F.coalesce("success", F.lit(False))
    by_scan = outcome.groupBy(scan).agg(
        F.sort_array(F.collect_list(F.struct("element_id", ok.alias("ok"), "instructions"))).alias("_seen")
    )
    prefixes = known_prefixes()
    joined = scans.join(by_scan.hint("merge"), scan, "left")
    entry = (
        "named_struct('element_id', s.element_id, 'category', v.category, 'confidence', v.confidence, "
        "'prefix', v.prefix, 'token', v.token, 'raw_hash', v.raw_hash, 'boundingBox', v.boundingBox)"
    )
    ours = (
        "flatten(transform(filter(coalesce(_seen, array()), s -> s.ok), s -> "
        f"transform(coalesce(s.instructions, array()), v -> {entry})))"
    )
    found = evaluate_once(joined, _all=ours)
    counted = evaluate_once(
        found,
        _lists="named_struct(" + ", ".join(
            f"'{p}', array_distinct(concat(registry.{p}, transform(filter(_all, v -> v.prefix = '{p}'), v -> v.token)))"
            for p in prefixes
        ) + ")",
    )
    placeholder = f"concat(v.prefix, '_', CAST({number_in('_lists', 'v.token', prefixes)} AS STRING))"
    blackouts = (
        "transform(_all, v -> named_struct('elementId', v.element_id, 'category', v.category, "
        f"'confidence', v.confidence, 'placeholder', {placeholder}, 'boundingBox', v.boundingBox, "
        "'action', 'blackout', 'source', 'vision'))"
    )
    # finer than the page log: one entry per element, category and raw value
    first = let(
        "keys", "transform(_all, v -> concat_ws('::', v.element_id, v.category, v.raw_hash))",
        "filter(_all, (v, i) -> array_position(keys, keys[i]) = i + 1)",
    )
    log = (
        f"transform({first}, v -> named_struct('id', v.element_id, 'category', v.category, "
        f"'confidence', v.confidence, 'source', 'vision', 'placeholder', {placeholder}, "
        "'selector', CAST(NULL AS STRING)))"
    )
    failed = "exists(coalesce(_seen, array()), s -> s.element_id <=> e.id AND NOT s.ok)"
    hit = "exists(_all, v -> v.element_id <=> e.id)"
    changed = {"sensitive": f"e.sensitive OR {hit}", "visualScanFailed": f"if({failed}, true, NULL)"}
    fields = ", ".join(f"'{f}', {changed.get(f, 'e.' + f)}" for f in ELEMENT_FIELDS)
    done = evaluate_once(
        counted, blackouts=blackouts, _log=log,
        _elements=f"transform(elements, e -> named_struct({fields}))",
    )
    kept = [c for c in scans.columns if c not in ("elements", "redactions", "registry")]
    return done.select(
        *kept, F.col("_elements").alias("elements"),
        F.concat("redactions", "_log").alias("redactions"), "blackouts",
    )


def blackout_rectangles(rows: DataFrame, box: str = "boundingBox") -> DataFrame:
    """Padded rectangles; ``labelled`` where a placeholder fits. Null boxes are skipped."""
    w, h = f"{box}.width + {2 * PAD_X}", f"{box}.height + {2 * PAD_Y}"
    return rows.where(F.col(box).isNotNull()).selectExpr(
        "*",
        f"greatest(0, {box}.x - {PAD_X}) AS rect_x",
        f"greatest(0, {box}.y - {PAD_Y}) AS rect_y",
        f"{w} AS rect_width",
        f"{h} AS rect_height",
        f"({h} >= {LABEL_MIN_HEIGHT} AND {w} >= {LABEL_MIN_WIDTH}) AS labelled",
    )


def applied_counts(rectangles: DataFrame, keys: list[str]) -> DataFrame:
    return rectangles.groupBy(*keys).agg(F.count(F.lit(1)).alias("applied_count"))
