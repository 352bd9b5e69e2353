"""Many strings searched in many texts at once.

Up to SHARD_BYTES of strings go to the tasks as one Aho-Corasick automaton, which finds all
places of all its strings in one pass. More strings stay where they are, and texts too: what
goes to the tasks is the list of lengths and two tables of bits, in which each string has set a
few bits by the hash of its beginning and by its own. A pass over a text hashes what stands at
every place, and only the pieces whose bits are set are taken out; these, a few more than the
hits, meet the strings in a join. So neither texts nor strings are repeated, and the join
compares the strings themselves, so that no result rests on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import staged

SHARD_BYTES = 2 << 20  # of strings in one automaton
SLICE_ROWS = 256  # texts that are held as Python strings at once
SLICE_BYTES = 1 << 18  # of texts that are hashed at once
LEAST_BITS, MOST_BITS = 16, 28  # powers of two: a table of bits takes 32 MB at most
BITS_A_STRING = 16
PROBES = 4

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def automaton(strings: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """Of (string, what to report)."""
    made = ahocorasick.Automaton()
    for text, mark in strings:
        made.add_word(text, mark)
    made.make_automaton()
    return made


def marks_in(made: ahocorasick.Automaton, text: str | None) -> list[str]:
    """What to report of the strings that occur in ``text``, each once."""
    if not text or not len(made):
        return []
    return sorted({mark for _, mark in made.iter(text)})


def search(texts: DataFrame, strings: DataFrame, key: str, text: str, string: str, mark: str) -> DataFrame:
    """(``key``, ``mark``) for each row of ``texts`` and each string of ``strings`` that occurs in
    its ``text``. ``strings`` has the columns ``string`` (distinct) and ``mark``.

    Null texts hold nothing, null and empty strings are left out, strings may hold each other.
    Rows that repeat a key are searched each for itself. Empty tables give an empty one.
    """
    spark = texts.sparkSession
    wanted = staged(
        strings.where(F.col(string) != "").select(F.col(string).alias("string"), F.col(mark).alias("mark")), "search-strings"
    )
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("string")), F.lit(0)).alias("n")).first()["n"]
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = texts.schema[key].dataType
    schema = StructType([StructField("key", kind), StructField("mark", strings.schema[mark].dataType)])

    if total <= SHARD_BYTES:
        few = spark.sparkContext.broadcast([(r["string"], r["mark"]) for r in wanted.collect()])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(few.value)
            for batch in batches:
                yield from _found(made, batch, schema.names)

        out = rows.mapInArrow(one, schema)
    else:
        out = _joined(rows, wanted, StructType([schema["key"], StructField("string", wanted.schema["string"].dataType)]))
    return out.select(F.col("key").alias(key), F.col("mark").alias(mark))


def _found(made: ahocorasick.Automaton, batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        marks = [marks_in(made, t) for t in part.column("text").to_pylist()]
        at = [i for i, found in enumerate(marks) for _ in found]
        yield pa.RecordBatch.from_arrays(
            [part.column("key").take(pa.array(at, pa.int64())), pa.array([m for found in marks for m in found], pa.string())], names=names
        )


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, by which any stretch of ``data`` is hashed in one step."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, back: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Of the ``size`` bytes from each place ``at``, all bits mixed."""
    h = (sums[at + size] - sums[at]) * back[at] + np.asarray(size, np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def _cells(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of each hash for one probe."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h + step * np.uint64(probe)) & np.uint64((1 << bits) - 1)


def _marked(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The places of ``h`` whose bits are all set."""
    left = np.arange(len(h))
    for probe in range(PROBES):
        cell = _cells(h[left], probe, bits)
        left = left[(table[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def _beginning(size: np.ndarray) -> np.ndarray:
    """The greatest power of two up to each length: so much of a string is asked for first."""
    return np.int64(1) << (np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a column of texts without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]: offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Of SLICE_BYTES of ``column`` or of one row."""
    if not batch.num_rows:
        return
    size = _bytes_of(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, size[start] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _bit_tables(wanted: DataFrame, bits: int) -> list[bytes]:
    """Two tables of bits, by the beginnings and by the whole of all strings. What comes to the
    driver are their set words, of 32 MB at most whatever the number of strings."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "string"):
                data, offsets = _bytes_of(part.column("string"))
                sums, back = _sums(data), _powers(_BACK, len(data) + 1)
                at, size = offsets[:-1], np.diff(offsets)
                for which, length in enumerate((_beginning(size), size)):
                    h = _hashes(sums, back, at, length)
                    cells = np.unique(np.concatenate([_cells(h, p, bits) for p in range(PROBES)]))
                    word = cells >> np.uint64(6)
                    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                    set_bits = np.bitwise_or.reduceat(np.uint64(1) << (cells & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(first), which, np.int32)), pa.array(word[first].astype(np.int64)),
                        pa.array(set_bits.view(np.int64)),
                    ], names=["which", "word", "bits"])

    found = wanted.select("string").mapInArrow(words, "which int, word long, bits long")
    found = staged(found.groupBy("which", "word").agg(F.bit_or("bits").alias("bits")), "search-bits")
    tables = []
    for which in (0, 1):
        table = np.zeros(1 << (bits - 6), np.int64)
        rows = found.where(F.col("which") == which).select("word", "bits").toArrow()
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        tables.append(table.astype("<i8").tobytes())
    return tables


def _pieces(
    data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, tables: list[np.ndarray], bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, length) of what may be one of the strings in texts laid end to end."""
    sums, back = _sums(data), _powers(_BACK, len(data) + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    rows, places, sizes = [], [], []
    begins = _beginning(lengths)
    for begin in np.unique(begins):
        at = np.arange(max(0, len(data) - int(begin) + 1))
        at = at[at + begin <= end[at]]
        at = at[_marked(tables[0], _hashes(sums, back, at, int(begin)), bits)]
        for size in lengths[begins == begin]:
            whole = at[at + size <= end[at]]
            whole = whole[_marked(tables[1], _hashes(sums, back, whole, int(size)), bits)]
            places.append(whole)
            sizes.append(np.full(len(whole), size))
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return np.searchsorted(offsets, at, "right") - 1, at, np.concatenate(sizes) if sizes else at


def _joined(rows: DataFrame, wanted: DataFrame, schema: StructType) -> DataFrame:
    spark = rows.sparkSession
    count = wanted.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_STRING * count).bit_length()))
    sizes = sorted(r["n"] for r in wanted.select(F.octet_length("string").alias("n")).distinct().collect())
    given = spark.sparkContext.broadcast((sizes, _bit_tables(wanted, bits)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array(given.value[0], np.int64)
        tables = [np.frombuffer(t, np.uint8) for t in given.value[1]]
        for batch in batches:
            for part in _slices(batch, "text"):
                data, offsets = _bytes_of(part.column("text"))
                row, at, size = _pieces(data, offsets, lengths, tables, bits)
                body = data.tobytes()
                # once a row; a piece that starts or ends inside a letter is none of the strings
                found = sorted({(r, body[a: a + n]) for r, a, n in zip(row.tolist(), at.tolist(), size.tolist())})
                kept = [(r, s) for r, s in found if _whole(s)]
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array([r for r, _ in kept], pa.int64())),
                    pa.array([s for _, s in kept], pa.binary()).cast(pa.string()),
                ], names=schema.names)

    return rows.mapInArrow(each, schema).join(wanted.hint("merge"), "string").select("key", "mark")


def _whole(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True
