"""Periodic runs of words.

A run is a stretch of consecutive words with smallest period q that no neighbour extends and
that is long enough. The table of match lengths M[i, q] = M[i - 1, q] + 1 where word i equals
word i - q is kept sparse: a cell exists only where an earlier occurrence opens it. A word
goes through its text with active lags; an occurrence at the active lag makes the match one
longer, and where the lag is not met again the diagonal ends and emits its run if that is
long enough.

Taking every earlier occurrence would cost the square of a word's count. Lags are therefore
dealt in octaves: for lags in (k/2, k] an occurrence counts only if the next k words agree,
and then only the latest. That loses nothing: a run of period q is at least 4q long, k is
less than 2q, so there are words of the run whose next k words lie in it; since k >= q and q
is the smallest period, the latest place where these k words occur before is exactly q words
back. By the same token a diagonal that is long enough ends where its run does, and its lag
is the smallest period. Strings of k words are named by doubling, and only those that occur
twice go on to the next octave, so a text costs n log n at worst and little more than one
sort where few strings repeat. All texts of an Arrow slice are worked through at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import private, slices, text_column, with_columns
from .words import Words, mix, split

SHORTEST, TIMES = 6, 4  # words of a run: at least so many, and so many periods
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def diagonals(words: Words, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs, as indexes into ``words``, by start and period."""
    if times < 4:
        raise ValueError("octaves of lags need runs of four periods or more")
    n = len(words)
    sizes = np.diff(words.first)
    found = [np.zeros((0, 3), np.int64)]
    room = words.first[words.doc + 1] - np.arange(n)  # words from here to the end of the text
    name = mix(words.hash ^ mix(words.doc.astype(np.uint64) + np.uint64(1)))  # differs by text
    alive = np.flatnonzero(sizes[words.doc] >= max(shortest, times))
    k = 1
    while len(alive):
        order = alive[np.argsort(name[alive], kind="stable")]
        again = name[order[1:]] == name[order[:-1]]
        here, latest = order[1:][again], order[:-1][again]
        lag = here - latest
        octave = (2 * lag > k) & (lag <= k)
        at, q = here[octave], lag[octave]
        by_place = np.argsort(at)
        at, q = at[by_place], q[by_place]
        if len(at):
            # a diagonal goes on while the next word meets the same lag
            opens = np.ones(len(at), bool)
            opens[1:] = (np.diff(at) != 1) | (np.diff(q) != 0)
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(at)) - 1
            start, end, period = at[first] - q[first], at[last] + k, q[first]
            long = end - start >= np.maximum(shortest, times * period)
            found.append(np.stack([start[long], end[long], period[long]], 1))
        repeated = np.zeros(n, bool)
        repeated[here] = repeated[latest] = True
        alive = np.flatnonzero(repeated)
        # lags beyond k need texts of more than ``times`` * k words
        alive = alive[(room[alive] >= 2 * k) & (sizes[words.doc[alive]] > times * k)]
        alive = alive[repeated[alive + k]]
        longer = mix(name[alive] * _A + name[alive + k] * _B)
        name[alive] = longer
        k *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: Words, runs: np.ndarray) -> np.ndarray:
    """Is each word kept? Those of a run after its first period are not."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """Add ``n_words`` (long), ``runs`` (array of start, length, period in words, by start and
    period) and ``collapsed`` (the text's words joined by one space, of each run the first
    period only) to every row.

    A run has at least ``shortest`` words and ``times`` (four or more) periods. Columns of
    these names are replaced. Null, empty and blank texts have no words and no runs. Texts are
    read whole, repeated rows each for itself; an empty table gives an empty one. Words are
    compared by 64-bit hashes.
    """
    text = private(docs, "text")
    schema = with_columns(docs, n_words="long", runs="array<struct<start:long,length:long,period:long>>", collapsed="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch, text):
                part = batch.slice(start, n)
                column = part.column(text)
                words = split(column)
                runs = diagonals(words, shortest, times)
                keep = collapsed(words, runs)
                cut = set(words.doc[~keep].tolist())
                texts = []
                for d, t in enumerate(column.to_pylist()):
                    own = t.encode().split()  # at 0x20 and 0x09-0x0D, as ``split``
                    if d in cut:
                        own = [w for w, k in zip(own, keep[words.first[d] : words.first[d + 1]].tolist()) if k]
                    texts.append(b" ".join(own).decode())
                doc = words.doc[runs[:, 0]]
                ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                fields = [runs[:, 0] - words.first[doc], runs[:, 1] - runs[:, 0], runs[:, 2]]
                made = {
                    "n_words": pa.array(np.diff(words.first), pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(RUN))),
                    "collapsed": pa.array(texts, pa.string()),
                }
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in schema.names], names=schema.names)

    return docs.withColumn(text, text_column(text_col)).mapInArrow(run, schema)
