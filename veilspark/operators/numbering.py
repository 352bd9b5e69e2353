"""Turning tokens into the placeholder numbers of a scan.

Two forms give the same numbers:

* ``number_in_row`` - the scan is one row (a document, a page of at most 200
  elements): array functions only, no shuffle.
* ``number_scans`` - a scan spans many rows (a conversation): only token events are
  shuffled, never texts, and no task ever receives a whole scan. Ranks come from
  counts per *chunk* of consecutive rows, so a scan that holds a third of all rows is
  numbered by as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detect import TOKEN
from ..functions.text import PREFIXES, let, literal
from ..session import staged

CHUNK = 1024
EVENTS_OUT = "array<struct<category:string,confidence:double,placeholder:string>>"


def evaluate_once(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns (SQL text) whose expressions are evaluated once per row.

    A plain projection is copied by the optimizer into every filter above it. The
    one-element ``inline`` keeps it in place.
    """
    fields = ", ".join(f"'{name}', {expr}" for name, expr in columns.items())
    return df.selectExpr("*", f"inline(array(named_struct({fields})))")


def known_prefixes(extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*PREFIXES.values(), *extra]))


def token_lists(events: str, prefixes: tuple[str, ...]) -> str:
    """struct with one list of distinct tokens, in order of first sight, per prefix."""
    fields = ", ".join(
        f"'{p}', array_distinct(transform(filter({events}, v -> v.prefix = '{p}'), v -> v.token))"
        for p in prefixes
    )
    return f"named_struct({fields})"


def number_in(lists: str, token: str, prefixes: tuple[str, ...], otherwise: str = "NULL") -> str:
    """1-based number of ``token`` among the tokens of its prefix.

    A token is a digest over prefix and value, so it is in one list only.
    """
    found = ", ".join(f"nullif(array_position({lists}.{p}, {token}), 0)" for p in prefixes)
    return f"coalesce({found}, {otherwise})"


def fill_numbers(text: str, number: str) -> str:
    """Replace every token in ``text`` by ``number``, SQL text over the token ``tok``.

    Only the token itself is replaced: the prefix before it is already plain text and
    may have been taken into a later match.
    """
    pattern = literal(TOKEN)
    filled = (
        f"array_join(zip_with(split({text}, {pattern}, -1), toks, (piece, tok) -> "
        f"concat(piece, if(tok IS NULL, '', coalesce(CAST({number} AS STRING), tok)))), '')"
    )
    return let(
        "toks", f"regexp_extract_all({text}, {pattern}, 0)",
        f"if(size(toks) > 0, {filled}, {text})",
    )


def numbered_events(events: str, number: str) -> str:
    """Events without tokens: category, confidence and the final placeholder."""
    return (
        f"transform({events}, v -> named_struct('category', v.category, 'confidence', v.confidence, "
        f"'placeholder', concat(v.prefix, '_', CAST({number} AS STRING))))"
    )


def number_in_row(text: str, events: str, prefixes: tuple[str, ...]) -> str:
    """struct(text, events) with numbers filled in, for a scan held in one row."""
    done = (
        f"named_struct('text', {fill_numbers(text, number_in('lists', 'tok', prefixes))}, "
        f"'events', {numbered_events(events, number_in('lists', 'v.token', prefixes))})"
    )
    plain = f"named_struct('text', {text}, 'events', CAST(array() AS {EVENTS_OUT}))"
    return f"if(size({events}) = 0, {plain}, {let('lists', token_lists(events, prefixes), done)})"


def rank_by_chunks(
    keys: DataFrame, group: list[str], position: str, tie: list[str], out: str,
    chunk: int = CHUNK,
) -> DataFrame:
    """``row_number() over (partition by group order by position, tie)`` without ever
    putting a whole group into one task.

    Rows are ranked inside chunks of ``chunk`` consecutive positions and shifted by the
    counts of earlier chunks. Two levels of counts keep every window partition small:
    a group of n positions has n/chunk counts, read in windows of ``chunk`` each, and
    n/chunk**2 totals.
    """
    c1, c2 = F.floor(F.col(position) / chunk), F.floor(F.col(position) / (chunk * chunk))
    keyed = keys.withColumn("_c1", c1).withColumn("_c2", c2)
    counts = keyed.groupBy(*group, "_c2", "_c1").agg(F.count(F.lit(1)).alias("_n"))
    inner = counts.withColumn(
        "_off1",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(*group, "_c2").orderBy("_c1")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    outer = (
        counts.groupBy(*group, "_c2").agg(F.sum("_n").alias("_n2"))
        .withColumn(
            "_off2",
            F.coalesce(
                F.sum("_n2").over(
                    Window.partitionBy(*group).orderBy("_c2")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n2")
    )
    offsets = inner.join(outer, [*group, "_c2"]).select(
        *group, "_c2", "_c1", (F.col("_off1") + F.col("_off2")).alias("_off")
    )
    local = keyed.withColumn(
        "_rn",
        F.row_number().over(
            Window.partitionBy(*group, "_c2", "_c1").orderBy(position, *tie)
        ),
    )
    return (
        local.join(offsets, [*group, "_c2", "_c1"])
        .withColumn(out, F.col("_rn") + F.col("_off"))
        .drop("_c1", "_c2", "_rn", "_off")
    )


def number_tokens(
    seen: DataFrame, scan: list[str], position: str, sequence: str, chunk: int = CHUNK
) -> DataFrame:
    """One row per distinct (scan, prefix, token) with its number ``n``.

    ``seen`` has the scan columns, ``prefix``, ``token`` and ``_first``, the
    struct(position, sequence) of a sighting; repeats are folded on the map side.
    """
    first = staged(
        seen.groupBy(*scan, "prefix", "token").agg(F.min("_first").alias("_first"))
        .select(
            *scan, "prefix", "token",
            F.col(f"_first.{position}").alias(position),
            F.col(f"_first.{sequence}").alias(sequence),
        ),
        "first-seen",
    )
    return rank_by_chunks(first, [*scan, "prefix"], position, [sequence], "n", chunk)
