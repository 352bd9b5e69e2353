"""Packing along a space-filling curve.

A text's hashed word counts are projected to three dimensions (sums of random signs of the
word hashes, scaled by the root of the word count), the point's place on a Hilbert curve is
its key, and texts are laid end to end in key order and cut every ``length`` tokens: texts
next to each other on the curve share sequences, and only the last sequence is not full.
That last rest is cut into sequences of falling powers of two, so nothing is padded at all.

Keys and token counts alone are sorted by range; token ids are compressed and moved once, to
meet their offsets. Positions come from sums within the sorted partitions and one sum over
the partitions' totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, Encoder, Vocabulary
from .tables import slices, staged, text_column
from .words import mix, split

DIMENSIONS = 3
BITS = 16  # of each coordinate
# Fixed value: the words of bpe.PATTERN without giving letters back, which is faster.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
KEEP_RUNS = 150_000  # runs of letters that a worker remembers
SPREAD = 4.0  # coordinates beyond this many standard deviations share the outermost cell


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), by transposing Gray codes."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each text; texts without words lie in the middle."""
    words = split(texts)
    n = np.diff(words.first)
    signs = mix(words.hash)
    point = np.zeros((len(n), DIMENSIONS))
    for k in range(DIMENSIONS):
        sign = 1.0 - 2.0 * ((signs >> np.uint64(k)) & np.uint64(1)).astype(np.float64)
        point[:, k] = np.bincount(words.doc, weights=sign, minlength=len(n)) / np.sqrt(np.maximum(n, 1))
    cell = (point / (2 * SPREAD) + 0.5) * (1 << BITS)
    return hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64))


def _word_encoder(vocabulary: Vocabulary):
    """Ids of a word by the tiktoken library; its ranks are the file's ids."""
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocabulary.id, special_tokens={}).encode_ordinary


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    length: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of texts in sequences of at most ``length`` tokens.

    One row a piece: ``id_col``, ``start`` (the text's ids before it), ``length``,
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers), ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence) and, unless ``with_ids`` is false, ``ids``
    (binary, packed alike). Each text ends with ``end_id``; null and empty texts are that id
    alone. Equal keys are ordered by row, so copies of one text spread over many tasks; rows
    that repeat an id are packed each for itself; null ids are kept. An empty table gives no
    rows. Other columns are not carried.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_column(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, _word_encoder(vocabulary.value), KEEP_RUNS)
        packer = zstandard.ZstdCompressor(level=1)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for start, n in slices(batch, "text", BLOCK_BYTES):
                part = batch.slice(start, n)
                ids = [x + last for x in encoder.encode_all(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(curve_keys(part.column("text")), pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([packer.compress(_planes(x)) for x in ids], pa.binary())],
                    names=["id", "key", "n", "ids"],
                )

    coded = staged(
        rows.mapInArrow(encode, "id long, key long, n long, ids binary")
        .withColumn("row", F.monotonically_increasing_id()),
        "pack-ids",
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(at, pa.int64())], names=["row", "n", "at"])

    order = staged(
        coded.select("key", "row", "n")
        .repartitionByRange("key", "row")
        .sortWithinPartitions("key", "row")
        .mapInArrow(sums, "row long, n long, at long")
        .withColumn("part", F.spark_partition_id()),
        "pack-order",
    )
    # one row a partition, so bounded by their number
    totals = order.groupBy("part").agg(F.sum("n").alias("tokens"))
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    before = totals.select(
        "part",
        (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"),
    )
    placed = order.join(F.broadcast(before), "part").select("row", (F.col("at") + F.col("before")).alias("at"))
    full, rest = divmod(whole, length)
    tail = [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]
    cuts = np.concatenate([[0], np.cumsum(tail, dtype=np.int64)]) + full * length  # fewer than 12

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            size = 0
            for doc, n, data, at in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "ids", "at"))):
                raw = _unplanes(unpacker.decompress(data, max_output_size=4 * n), n)
                start = 0
                while start < n:
                    pos = at + start
                    if pos < full * length:
                        sequence, offset = divmod(pos, length)
                        stop = length - offset
                    else:
                        k = int(np.searchsorted(cuts, pos, "right")) - 1
                        sequence, offset = full + k, pos - int(cuts[k])
                        stop = int(cuts[k + 1]) - pos
                    take = min(stop, n - start)
                    piece = raw[4 * start : 4 * (start + take)]
                    for column, value in zip(out, (doc, start, take, zlib.crc32(piece), n, sequence, offset, piece if with_ids else b"")):
                        column.append(value)
                    start += take
                    size += len(piece)
                if size > 8 << 20:
                    yield _pieces(out, names, with_ids)
                    out, size = [[] for _ in range(8)], 0
            if out[0]:
                yield _pieces(out, names, with_ids)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = ", ".join(f"`{n}` {'binary' if n == 'ids' else 'long'}" for n in names)
    return coded.select("row", "id", "n", "ids").join(placed, "row").select("id", "n", "ids", "at").mapInArrow(cut, schema)


def _pieces(columns: list[list], names: list[str], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _planes(ids: bytes) -> bytes:
    """Bytes of equal rank together; the upper ones are zero in most vocabularies."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes, n: int) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(4, n).T.tobytes()
