"""Which keys occur in texts of different ids? Answered for all shards at once.

A shard is a few MB of texts. It sorts its distinct keys and sends each bucket of the key
space one row that holds them packed; a key that every text has costs one entry a shard.
A bucket answers each shard with one bit a key, in the order sent, so nothing is looked up
on the way back. Buckets are read one after the other in sorted order: a task holds one.

Narrow keys only ask "in two texts or more?". Wide keys carry a second hash, and bring back
the least and the greatest id among all texts that have the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after every other
SENT = "bucket long, shard long, keys binary"
BACK = "shard long, bucket long, answer binary"
_SENT = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())])
_BACK = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


def shards(df: DataFrame, text: str, id_col: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with a shard number made of id and text, about SHARD_BYTES of texts a shard;
    and the number of bits that give as many buckets as shards."""
    size = df.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(count))
    return df.withColumn(name, shard), max(1, (count - 1).bit_length())


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together: the empty ones compress away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").reshape(n)


def _low_bytes(x: np.ndarray, k: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k]).tobytes()


def _from_low_bytes(raw: np.ndarray, n: int, k: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = raw.reshape(n, k)
    return out.view("<u8").reshape(n)


@dataclass
class Distinct:
    """Distinct keys of a shard in sorted order; ``of`` leads from each key given to its own."""

    a: np.ndarray
    b: np.ndarray | None
    low: np.ndarray
    high: np.ndarray
    of: np.ndarray

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray | None = None):
        order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
        a, b, ids = a[order], None if b is None else b[order], ids[order]
        new = np.ones(len(a), dtype=bool)
        if len(a):
            new[1:] = a[1:] != a[:-1]
            if b is not None:
                new[1:] |= b[1:] != b[:-1]
        head = np.flatnonzero(new)
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.a, self.b = a[head], None if b is None else b[head]
        self.low = np.minimum.reduceat(ids, head) if len(head) else ids
        self.high = np.maximum.reduceat(ids, head) if len(head) else ids

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, starts and ends of the buckets."""
        bucket = (self.a >> np.uint64(64 - bits)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        return bucket[head], head, np.r_[head[1:], len(bucket)][: len(head)]

    def sent(self, shard: int, bits: int) -> pa.Table:
        number, head, end = self.buckets(bits)
        packed = []
        for h, e in zip(head, end):
            data = _low_bytes(self.a[h:e], 6)
            if self.b is None:
                data += np.packbits(self.low[h:e] < self.high[h:e]).tobytes()
            else:
                data += _low_bytes(self.b[h:e], 4) + _planes(self.low[h:e]) + _planes(self.high[h:e])
            packed.append(data)
        return pa.table(
            [pa.array(number, pa.int64()), pa.array(np.full(len(head), shard), pa.int64()),
             pa.array(packed, pa.binary())],
            schema=_SENT,
        )

    def answered(self, back: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct key: in texts of two ids or more?, least id, greatest id."""
        yes = np.zeros(len(self.a), dtype=bool)
        low, high = self.low.copy(), self.high.copy()
        number, head, end = self.buckets(bits)
        place = {int(k): i for i, k in enumerate(number)}
        for bucket, data in zip(back.column("bucket").to_pylist(), back.column("answer").to_pylist()):
            h, e = head[place[bucket]], end[place[bucket]]
            raw, n = np.frombuffer(data, np.uint8), int(e - h)
            mask = np.unpackbits(raw[: -(-n // 8)], count=n).astype(bool)
            yes[h:e] = mask
            if self.b is not None:
                k, at = int(mask.sum()), -(-n // 8)
                low[h:e][mask] = _unplanes(raw[at : at + 8 * k], k)
                high[h:e][mask] = _unplanes(raw[at + 8 * k :], k)
        return yes, low, high


def _unpacked(data: bytes, wide: bool, row: int):
    raw = np.frombuffer(data, np.uint8)
    if wide:
        n = len(raw) // 26
        a, b = _from_low_bytes(raw[: 6 * n], n, 6), _from_low_bytes(raw[6 * n : 10 * n], n, 4)
        return a, b, _unplanes(raw[10 * n : 18 * n], n), _unplanes(raw[18 * n :], n)
    n = len(raw) * 8 // 49
    a, many = _from_low_bytes(raw[: 6 * n], n, 6), np.unpackbits(raw[6 * n :], count=n).astype(bool)
    return a, None, np.where(many, -1, row), np.full(n, row, np.int64)


def _answers(shard: list[int], blobs: list[bytes], wide: bool) -> Iterator[tuple[int, bytes]]:
    parts = [_unpacked(x, wide, i) for i, x in enumerate(blobs)]
    sizes = [len(p[0]) for p in parts]
    a = np.concatenate([p[0] for p in parts])
    low, high = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    if wide:
        b = np.concatenate([p[1] for p in parts])
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new = np.r_[True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]
    else:
        order = np.argsort(a, kind="stable")
        sa = a[order]
        new = np.r_[True, sa[1:] != sa[:-1]]
    head, group = np.flatnonzero(new), np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    least, most = np.minimum.reduceat(low[order], head), np.maximum.reduceat(high[order], head)
    yes = (least < most)[group]
    at = 0
    for s, n in zip(shard, sizes):
        mask, own = yes[at : at + n], group[at : at + n]
        if mask.any():
            data = np.packbits(mask).tobytes()
            if wide:
                data += _planes(least[own[mask]]) + _planes(most[own[mask]])
            yield s, data
        at += n


def shared(rows: DataFrame, wide: bool) -> DataFrame:
    """Answers to the rows of ``Distinct.sent``, for ``Distinct.answered``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, blobs = None, [], []

        def flush():
            got = list(_answers(shard, blobs, wide)) if blobs else []
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([now] * len(got), pa.int64()),
                     pa.array([g[1] for g in got], pa.binary())],
                    schema=_BACK,
                )

        for batch in batches:
            for k, s, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != now:
                    yield from flush()
                    now, shard, blobs = k, [], []
                shard.append(s)
                blobs.append(data)
        yield from flush()

    return (
        rows.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(answer, BACK)
    )


def ids_of(table: pa.Table, column: str) -> np.ndarray:
    return pa.compute.fill_null(table.column(column).cast(pa.int64()), NO_ID).to_numpy()
