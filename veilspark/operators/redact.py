"""Redaction of text tables: one row per scan, or many rows per scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import redact
from ..functions.rules import RULES, PiiRule
from ..functions.text import let
from ..session import staged
from .numbering import (
    CHUNK,
    EVENTS_OUT,
    evaluate_once,
    fill_numbers,
    known_prefixes,
    number_in_row,
    number_tokens,
    numbered_events,
)


def redact_rows(
    df: DataFrame, text: str = "text", rules: Sequence[PiiRule] = RULES
) -> DataFrame:
    """Every row is a scan of its own. ``text`` is redacted in place and ``events``
    (category, confidence, placeholder) is added. One narrow stage: no shuffle."""
    prefixes = known_prefixes(tuple(r.prefix for r in rules))
    done = let("fold", redact(text, rules), number_in_row("fold.text", "fold.events", prefixes))
    others = [c for c in df.columns if c != text]
    return evaluate_once(df, _done=done).select(
        *others, F.col("_done.text").alias(text), F.col("_done.events").alias("events")
    )


def redact_scans(
    df: DataFrame,
    scan: list[str],
    position: str,
    text: str = "text",
    rules: Sequence[PiiRule] = RULES,
    chunk: int = CHUNK,
) -> DataFrame:
    """A scan is many rows, ordered by the integer column ``position``.

    The table is read and folded once, and the folded rows, whose tokens carry no raw
    value, are written to the shared folder; numbering and substitution start from there.
    What is shuffled is the distinct tokens and the rows with events, by chunk.
    """
    others = [c for c in df.columns if c != text]
    folded = staged(
        evaluate_once(df, _fold=redact(text, rules)).select(
            *others, "_fold", F.floor(F.col(position) / chunk).alias("_chunk")
        ),
        "folded",
    )
    events = folded.where(F.size("_fold.events") > 0).select(
        *scan, position, "_chunk", F.posexplode("_fold.events").alias("_seq", "_e")
    ).select(
        *scan, position, "_chunk", "_seq",
        F.col("_e.prefix").alias("prefix"), F.col("_e.token").alias("token"),
    )
    # A value repeated all over a scan is folded to one row per chunk, before anything
    # else: numbering and substitution both start from this one shuffle.
    seen = staged(
        events.groupBy(*scan, "_chunk", "prefix", "token").agg(
            F.min(F.struct(F.col(position), F.col("_seq"))).alias("_first")
        ),
        "tokens",
    )
    numbers = number_tokens(seen, scan, position, "_seq", chunk)
    by_chunk = (
        seen.join(numbers.select(*scan, "prefix", "token", "n"), [*scan, "prefix", "token"])
        .groupBy(*scan, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_first", "token", "n"))).alias("_list"))
        .select(*scan, "_chunk", F.expr(
            "map_from_entries(transform(_list, x -> struct(x.token, x.n)))"
        ).alias("_numbers"))
    )
    clean = folded.where(F.size("_fold.events") == 0).select(
        *others, F.col("_fold.text").alias(text), F.expr(f"CAST(array() AS {EVENTS_OUT})").alias("events")
    )
    hit = folded.where(F.size("_fold.events") > 0).join(by_chunk, [*scan, "_chunk"], "left")
    final = fill_numbers("_fold.text", "try_element_at(_numbers, tok)")
    events_out = numbered_events("_fold.events", "try_element_at(_numbers, v.token)")
    hit = hit.select(
        *others, F.expr(final).alias(text), F.expr(events_out).alias("events")
    )
    return clean.unionByName(hit)
