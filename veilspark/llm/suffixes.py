"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at content-selected positions: in every run of 27 8-word grams the
leftmost one with the least hash (a minimiser). A passage of 50 words holds such a run at
its start, so of two copies the same suffix is kept, with 24 words or more in common.

1. Kept suffixes are written as three hashes of 8 words each and sorted (a suffix array over
   an alphabet of 8-word blocks, in buckets of the first block). Neighbours equal in all
   three blocks share 24 words.
2. Suffixes with such a neighbour in another text are extended to the left and to the right:
   the windows of 50 words whose minimiser they are get compared as wholes.
3. Windows found in texts of different ids are joined to maximal spans.

Extension goes by window hashes, not pair by pair: a passage that a third of all texts share
costs each text its own words and nothing more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NO_ID, SENT, Distinct, ids_of, shards, shared
from .tables import private, text_column
from .words import inside, mix, split, window_hashes

GRAM = 8
BLOCKS = 3
SPANS = "long, start long, n_words long, other_id long, text string"


def _minimisers(words, length: int):
    """For each window of ``length`` words its start and the word index of its minimiser."""
    start = np.flatnonzero(inside(words, length))
    if not len(start):
        return start, start
    gram = window_hashes(words.hash, GRAM)
    run = length - BLOCKS * GRAM + 1  # grams looked at: the suffix keeps BLOCKS * GRAM words
    at = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 16):
        s = start[i : i + (1 << 16)]
        view = sliding_window_view(gram[s[0] : s[-1] + run], run)
        at[i : i + len(s)] = s + view[s - s[0]].argmin(axis=1)
    return start, at


def _suffix_keys(words, at: np.ndarray) -> np.ndarray:
    """The first three 8-word blocks of each suffix, folded to one sortable key.

    The top bits are the first block's, so suffixes sort by it first; mixed again, as a
    minimiser's hash is small and small keys would all lie in one bucket."""
    gram = window_hashes(words.hash, GRAM)
    rest = window_hashes(words.hash, GRAM * (BLOCKS - 1))
    top = np.uint64(0xFFFFFFFF00000000)
    return (mix(gram[at]) & top) | (rest[at + GRAM] >> np.uint64(32))


def repeated_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal spans of words that are covered by windows of ``length`` words which also
    occur in a text with another id.

    One row a span: ``id_col``, ``start`` (word index), ``n_words``, ``other_id`` (another
    text with the span's first window: the one of the least id, or of the greatest if the
    least is its own) and ``text`` (the words). Null text:
    no words. A null id counts as one text, after all others, and is given back as null; as
    ``other_id`` it is null too. Rows that repeat an id count as one text. Texts under
    ``length`` words give no rows; other columns are not carried, so none can clash.
    """
    if length < (BLOCKS + 1) * GRAM:
        raise ValueError(f"a passage needs {(BLOCKS + 1) * GRAM} words or more")
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), text_column(text_col).alias("_text"))
    rows, bits = shards(docs, "_text", "_id", "_shard")
    sent_schema = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())])

    def suffixes(table: pa.Table):
        words, ids = split(table.column("_text")), ids_of(table, "_id")
        start, at = _minimisers(words, length)
        kept = np.unique(at)
        return words, ids, start, at, kept, Distinct(ids[words.doc[kept]], _suffix_keys(words, kept))

    def send_suffixes(table: pa.Table) -> pa.Table:
        return suffixes(table)[5].sent(table.column("_shard")[0].as_py(), bits)

    def windows(table: pa.Table, back: pa.Table):
        words, ids, start, at, kept, keys = suffixes(table)
        met = keys.answered(back, bits)[0][keys.of]
        start = start[met[np.searchsorted(kept, at)]]
        a, b = window_hashes(words.hash, length)[start], window_hashes(words.hash, length, 1)[start]
        return words, ids, start, Distinct(ids[words.doc[start]], a, b)

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(table) or not len(back):
            return sent_schema.empty_table()
        return windows(table, back)[3].sent(table.column("_shard")[0].as_py(), bits)

    span_schema = pa.schema([
        (id_col, pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()),
        ("other_id", pa.int64()), ("text", pa.string()),
    ])

    def spans(table: pa.Table, back: pa.Table) -> pa.Table:
        wide = back.column("wide").to_numpy(zero_copy_only=False).astype(bool) if len(back) else np.zeros(0, bool)
        words, ids, start, keys = windows(table, back.filter(pa.array(~wide)))
        yes, low, high = (x[keys.of] for x in keys.answered(back.filter(pa.array(wide)), bits))
        start, low, high = start[yes], low[yes], high[yes]
        if not len(start):
            return span_schema.empty_table()
        doc = words.doc[start]
        new = np.r_[True, (start[1:] > start[:-1] + length) | (doc[1:] != doc[:-1])]
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(start)] - 1
        first, end = start[head], start[last] + length
        own = ids[doc[head]]
        other = np.where(low[head] == own, high[head], low[head])
        texts = table.column("_text").cast(pa.large_binary()).to_pylist()
        base = np.zeros(len(table) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=base[1:])
        cut = [
            texts[d][words.start[s] - base[d] : words.end[e - 1] - base[d]]
            for d, s, e in zip(doc[head], first, end)
        ]
        return pa.table(
            [
                pa.array(own, pa.int64(), mask=own == NO_ID),
                pa.array(first - words.first[doc[head]], pa.int64()),
                pa.array(end - first, pa.int64()),
                pa.array(other, pa.int64(), mask=other == NO_ID),
                pa.array(cut, pa.binary()).cast(pa.string()),
            ],
            schema=span_schema,
        )

    met = shared(rows.groupBy("_shard").applyInArrow(send_suffixes, SENT), wide=False)
    found = shared(rows.groupBy("_shard").cogroup(met.groupBy("shard")).applyInArrow(send_windows, SENT), wide=True)
    answers = met.withColumn("wide", F.lit(False)).unionByName(found.withColumn("wide", F.lit(True)))
    schema = f"`{id_col}` {SPANS}"
    return rows.groupBy("_shard").cogroup(answers.groupBy("shard")).applyInArrow(spans, schema)
