"""Substring deduplication by difference-cover anchors.

Positions of a text are taken modulo 7, and only those in the cover {0, 1, 3} are anchors:
every remainder is a difference of two of them. Two equal windows of ``window`` words at
positions i and j therefore have an offset d < 7 with both i + d and j + d on the cover, and
the words from there to the window's end, ``window - 6`` of them, are one and the same
anchor. So:

1. hash anchors of ``window - 6`` words at cover positions (3 of 7 words) and keep those
   that occur in texts of different ids;
2. extend: only windows around such an anchor are hashed whole, with the least id of the
   texts that have them;
3. in a text with a greater id, every word under such a window goes.

Texts are shuffled once, by shard; Spark reuses that exchange for all three steps. No pairs
of texts are made: the work is linear in words however many texts share a passage.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import SENT, Distinct, ids_of, shards, shared
from .tables import private, text_column, with_columns
from .words import inside, split, window_hashes

PERIOD = 7
COVER = (0, 1, 3)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(words, window: int):
    """Word indexes of the anchors and their hashes."""
    length = window - PERIOD + 1
    ok = inside(words, length)
    ok &= _ON_COVER[words.position[: len(ok)] % PERIOD]
    at = np.flatnonzero(ok)
    return at, window_hashes(words.hash, length)[at]


def _windows(words, window: int, at: np.ndarray):
    """Starts of the windows that hold one of the anchors at ``at``, and two hashes of each."""
    fits = inside(words, window)
    marked = np.zeros(len(words) + 1, dtype=np.int64)
    if len(fits):
        anchor = np.zeros(len(words), dtype=np.int64)
        anchor[at] = 1
        np.cumsum(anchor, out=marked[1:])
        i = np.arange(len(fits))
        fits &= marked[np.minimum(i + PERIOD, len(words))] > marked[i]
    start = np.flatnonzero(fits)
    return start, window_hashes(words.hash, window)[start], window_hashes(words.hash, window, 1)[start]


def covered(n: int, start: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie under a window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(
    docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", layout: bool = False,
    words_col: str = "n_words", removed_col: str = "n_removed",
) -> DataFrame:
    """Remove each word covered by a window of ``window`` words whose word sequence also
    starts in a text with a smaller id.

    Returns all rows and columns; ``text_col`` holds the kept words joined by one space, and
    the longs ``words_col`` and ``removed_col`` are added (they replace columns so named).
    With ``layout`` a text that loses nothing is given back as it was, white space included.
    Windows are judged on the input. Null text: no words, empty result. A null id is after
    all others. Rows that repeat an id count as one text: they do not remove from each
    other. Texts shorter than a window stay. An empty table gives an empty one.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window needs more than {PERIOD} words")
    docs = docs.withColumn(text_col, text_column(text_col))
    shard = private(docs, "shard")
    out_schema = with_columns(docs, **{words_col: "long", removed_col: "long"})
    rows, bits = shards(docs, text_col, id_col, shard)

    def send_anchors(table: pa.Table) -> pa.Table:
        words = split(table.column(text_col))
        at, key = _anchors(words, window)
        return Distinct(ids_of(table, id_col)[words.doc[at]], key).sent(table.column(shard)[0].as_py(), bits)

    def shared_windows(table: pa.Table, back: pa.Table):
        words = split(table.column(text_col))
        ids = ids_of(table, id_col)
        at, key = _anchors(words, window)
        anchors = Distinct(ids[words.doc[at]], key)
        start, a, b = _windows(words, window, at[anchors.answered(back, bits)[0][anchors.of]])
        return words, ids, start, Distinct(ids[words.doc[start]], a, b)

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(table) or not len(back):
            return pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())]).empty_table()
        keys = shared_windows(table, back)[3]
        return keys.sent(table.column(shard)[0].as_py(), bits)

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        # answers to anchors and to windows come in one table; the latter are marked
        wide = back.column("wide").to_numpy(zero_copy_only=False).astype(bool) if len(back) else np.zeros(0, bool)
        anchors_back, windows_back = back.filter(pa.array(~wide)), back.filter(pa.array(wide))
        words, ids, start, keys = shared_windows(table, anchors_back)
        low = keys.answered(windows_back, bits)[1][keys.of]
        gone = covered(len(words), start[low < ids[words.doc[start]]], window)
        text, removed = [], np.zeros(len(table), np.int64)
        np.add.at(removed, words.doc, gone)
        for i, value in enumerate(table.column(text_col).cast(pa.large_binary()).to_pylist()):
            if removed[i]:
                stays = ~gone[words.first[i] : words.first[i + 1]]
                text.append(b" ".join(itertools.compress(value.split(), stays)))
            else:
                text.append(value if layout else b" ".join(value.split()))
        made = {
            text_col: pa.array(text, pa.binary()).cast(pa.string()),
            words_col: pa.array(np.diff(words.first), pa.int64()),
            removed_col: pa.array(removed, pa.int64()),
        }
        return pa.table([made[n] if n in made else table.column(n) for n in out_schema.names], names=out_schema.names)

    found = shared(rows.groupBy(shard).applyInArrow(send_anchors, SENT), wide=False)
    windows = shared(
        rows.groupBy(shard).cogroup(found.groupBy("shard")).applyInArrow(send_windows, SENT), wide=True
    )
    answers = found.withColumn("wide", F.lit(False)).unionByName(windows.withColumn("wide", F.lit(True)))
    return rows.groupBy(shard).cogroup(answers.groupBy("shard")).applyInArrow(cut, out_schema)
