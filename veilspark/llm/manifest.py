"""Merkle manifest of a dataset, a tree per group and a root over the groups.

A leaf's coordinate is its rank among its group's ids. Ranks are read from bitmaps, without
sorting leaves: each task turns the ids it meets into compressed bitmaps of CHUNK ids (a list
of low bits where few, a bit set where many, and counts of ids that repeat), those of one
chunk are merged, and a popcount directory gives what lies before. Leaves then meet the bitmap
of their chunk and count the bits below theirs.

Coordinates are slots: a block of BLOCK consecutive leaves is one keyed array, in which
several levels are reduced at once, so a tree of n leaves takes log(n) / log(BLOCK) shuffles,
each of a table BLOCK times smaller. On the way back a block learns the siblings above it,
and each leaf's proof is its siblings within the block, then those.

Hashes are sha256 in lowercase hex; a node hashes the concatenated digests of its children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged

FAN = 8  # children of a node
LEVELS = 3  # reduced in one block
BLOCK = FAN**LEVELS
CHUNK = 1 << 16  # ids of a bitmap
SPARSE = CHUNK // 16  # most ids of a chunk that are listed rather than set as bits
HOT = 1000  # a chunk that holds this part of all rows is salted, so there are no more than that
SALTS = 64
AT_ONCE = 1 << 20  # rows that a task turns into bitmaps at once

DIGEST = hashlib.sha256


def hashed(text: str) -> str:
    return DIGEST(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """A value with its byte count before it, ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


# -- bitmaps ---------------------------------------------------------------------------------


def pack_bitmap(low: np.ndarray, copies: np.ndarray) -> bytes:
    """Distinct sorted low bits and how often each occurs, compressed."""
    many = copies > 1
    if len(low) <= SPARSE:
        kind, body = b"L", low.astype("<u2").tobytes()
    else:
        bits = np.zeros(CHUNK, bool)
        bits[low] = True
        kind, body = b"B", np.packbits(bits, bitorder="little").tobytes()
    extra = low[many].astype("<u2").tobytes() + (copies[many] - 1).astype("<i8").tobytes()
    return kind + len(body).to_bytes(4, "little") + body + extra


def unpack_bitmap(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Low bits and copies of ``pack_bitmap``."""
    size = int.from_bytes(data[1:5], "little")
    body, extra = data[5 : 5 + size], data[5 + size :]
    if data[:1] == b"L":
        low = np.frombuffer(body, "<u2").astype(np.int64)
    else:
        low = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    copies = np.ones(len(low), np.int64)
    n = len(extra) // 10
    if n:
        copies[np.searchsorted(low, np.frombuffer(extra[: 2 * n], "<u2"))] += np.frombuffer(extra[2 * n :], "<i8")
    return low, copies


def merge_bitmaps(parts: list[bytes]) -> tuple[bytes, int]:
    """One bitmap of all, and the number of rows it stands for."""
    if len(parts) == 1:
        return parts[0], int(unpack_bitmap(parts[0])[1].sum())
    lows, copies = zip(*map(unpack_bitmap, parts))
    low, at = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.zeros(len(low), np.int64)
    np.add.at(total, at, np.concatenate(copies))
    return pack_bitmap(low, total), int(total.sum())


class Ranks:
    """Rank queries on one bitmap. A bit set has a directory of popcounts before each 64-bit
    word, and the bits below are counted within the word; a list is searched. Copies of lower
    ids count too."""

    def __init__(self, data: bytes):
        low, copies = unpack_bitmap(data)
        self.low = low
        self.words = self.directory = None
        if data[:1] == b"B":
            self.words = np.frombuffer(data, "<u8", CHUNK // 64, 5)
            counts = np.bitwise_count(self.words).astype(np.int64)
            self.directory = np.cumsum(counts) - counts
        self.repeated = low[copies > 1]
        self.extra = np.cumsum(np.append(0, copies[copies > 1] - 1))

    def of(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a lower id, and rows with this id."""
        if self.words is None:
            rank = np.searchsorted(self.low, low)
        else:
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.directory[word] + np.bitwise_count(below)
        same = np.ones(len(low), np.int64)
        if len(self.repeated):
            place = np.searchsorted(self.repeated, low)
            rank = rank + self.extra[place]
            hit = np.append(self.repeated, -1)[place] == low
            same[hit] += np.diff(self.extra)[place[hit]]
        return rank.astype(np.int64), same


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, chunk, bitmap) for each chunk that the rows (grp, id) of a task meet, worked
    through AT_ONCE rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            yield _bitmap_rows(pa.Table.from_batches(held).combine_chunks())
            held = []
    if sum(b.num_rows for b in held):
        yield _bitmap_rows(pa.Table.from_batches(held).combine_chunks())


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([np.diff(k) != 0 for k in keys], axis=0)
    return np.flatnonzero(new)


def _bitmap_rows(rows: pa.Table) -> pa.RecordBatch:
    grp = rows.column("grp").combine_chunks().dictionary_encode()
    if isinstance(grp, pa.ChunkedArray):
        grp = grp.chunk(0)
    code, ids = grp.indices.to_numpy(), rows.column("id").to_numpy()
    order = np.lexsort((ids, code))
    ids, code = ids[order], code[order]
    at = _edges(ids, code)
    copies = np.diff(np.append(at, len(ids)))
    ids, code = ids[at], code[at]
    chunk = ids // CHUNK
    starts = _edges(chunk, code)
    packed = [pack_bitmap(ids[a:b] % CHUNK, copies[a:b]) for a, b in zip(starts, np.append(starts[1:], len(ids)))]
    return pa.RecordBatch.from_arrays(
        [grp.dictionary.take(pa.array(code[starts])), pa.array(chunk[starts], pa.int64()), pa.array(packed, pa.binary())],
        names=["grp", "chunk", "bitmap"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [merge_bitmaps(parts) for parts in batch.column("bitmaps").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("grp"), batch.column("chunk"), pa.array([b for b, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64())],
            names=["grp", "chunk", "bitmap", "n"],
        )


def running(rows: DataFrame, keys: list[str], amount: str, name: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over all rows with lower (unique) keys. Rows are
    dealt by ranges; one total a partition is summed up beyond that."""
    dealt = staged(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)
    within = Window.partitionBy("part").orderBy(*keys)
    totals = dealt.groupBy("part").agg(F.sum(amount).alias("total"))  # as many as partitions
    parts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("earlier"))
    return (
        dealt.withColumn("before", F.sum(amount).over(within) - F.col(amount))
        .join(F.broadcast(parts), "part")
        .withColumn("before", F.col("before") + F.col("earlier"))
        .drop("part", "earlier")
    )


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank leaves by the bitmap that stands before them: rows come by (grp, chunk, salt), the
    bitmap's row first. Holds one bitmap at a time."""
    ranks, base, size, current = None, 0, 0, None
    for batch in batches:
        grp, chunk, salt, ids = (batch.column(c).to_pylist() for c in ("grp", "chunk", "salt", "id"))
        bitmap = batch.column("bitmap")
        keys = list(zip(grp, chunk, salt))
        heads = [i for i, ok in enumerate(bitmap.is_valid().to_pylist()) if ok]
        out = []
        for i, j in zip([0, *[h + 1 for h in heads]], [*heads, len(keys)]):
            if i < j:
                if keys[i] != current or keys[j - 1] != current:
                    raise AssertionError("leaves without the bitmap of their chunk")
                rank, same = ranks.of(np.array(ids[i:j], np.int64) % CHUNK)
                cols = [batch.column(c).slice(i, j - i) for c in ("grp", "id", "leaf", "altered")]
                out.append(pa.RecordBatch.from_arrays(
                    [*cols, pa.array(base + rank), pa.array(same), pa.array(np.full(j - i, size))],
                    names=["grp", "id", "leaf", "altered", "idx", "same", "n"],
                ))
            if j < len(keys):
                ranks, current = Ranks(bitmap[j].as_py()), keys[j]
                base, size = batch.column("before")[j].as_py(), batch.column("n")[j].as_py()
        yield from out


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, id, leaf, altered; a written table without nulls in grp and id) with
    ``idx``, the row's place in its group by id, and ``n``, the rows of the group. Rows of one
    id come in the order of ``leaf``; rows alike in both share out their places."""
    parts = leaves.select("grp", "id").mapInArrow(_bitmaps, "grp string, chunk long, bitmap binary")
    merged = (
        parts.groupBy("grp", "chunk").agg(F.collect_list("bitmap").alias("bitmaps"))
        .mapInArrow(_merged, "grp string, chunk long, bitmap binary, n long")
    )
    placed = running(merged, ["grp", "chunk"], "n", "manifest-bitmaps")
    groups = placed.groupBy("grp").agg(F.min("before").alias("first"), F.sum("n").alias("all"))
    directory = staged(
        placed.withColumnRenamed("n", "rows").join(groups, "grp")
        .select("grp", "chunk", "bitmap", "rows", (F.col("before") - F.col("first")).alias("before"), F.col("all").alias("n")),
        "manifest-directory",
    )
    total = directory.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    # no more than HOT chunks can hold a HOT-th of all rows each
    hot = F.broadcast(directory.where(F.col("rows") * HOT >= total).select("grp", "chunk", F.lit(SALTS).alias("salts")))
    asked = (
        leaves.withColumn("chunk", F.shiftright("id", CHUNK.bit_length() - 1)).join(hot, ["grp", "chunk"], "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "leaf"), F.col("salts")), F.lit(0)).cast("int"))
        .select("grp", "chunk", "salt", F.lit(1).alias("late"), "id", "leaf", "altered",
                F.lit(None).cast("binary").alias("bitmap"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("n"))
    )
    last = F.when(F.col("rows") * HOT >= total, SALTS - 1).otherwise(0)
    offered = directory.select(
        "grp", "chunk", F.explode(F.sequence(F.lit(0), last)).alias("salt"), F.lit(0).alias("late"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("altered"),
        "bitmap", "before", "n",
    )
    ranked = staged(
        offered.unionByName(asked).repartition("grp", "chunk", "salt")
        .sortWithinPartitions("grp", "chunk", "salt", "late")
        .mapInArrow(_queries, "grp string, id long, leaf string, altered string, idx long, same long, n long"),
        "manifest-ranks",
    )
    plain = ["grp", "idx", "n", "id", "leaf", "altered"]
    # rows that share an id: buckets by the head of the leaf, then places within a bucket
    ties = ranked.where("same > 1").withColumn("bucket", F.substring("leaf", 1, 3))
    counts = ties.groupBy("grp", "id", "bucket").agg(F.count("*").alias("c"))
    earlier = counts.withColumn("c", F.sum("c").over(Window.partitionBy("grp", "id").orderBy("bucket")) - F.col("c"))
    in_bucket = F.row_number().over(Window.partitionBy("grp", "id", "bucket").orderBy("leaf", "altered")) - 1
    tied = ties.withColumn("k", in_bucket).join(earlier, ["grp", "id", "bucket"]).withColumn("idx", F.col("idx") + F.col("c") + F.col("k"))
    return ranked.where("same = 1").select(*plain).unionByName(tied.select(*plain))


# -- levels ----------------------------------------------------------------------------------


def reduced(nodes: list[str], levels: int | None) -> list[list[str]]:
    """Levels above ``nodes``, that first; so many, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([hashed("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """For each level but the last the digests beside the path from slot ``at``, joined."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % FAN
        out.append("".join(nodes[run:at] + nodes[at + 1 : run + FAN]))
        at //= FAN
    return out


def folded(node: str, at: int, proof: list[str]) -> str:
    """The root that ``node`` in slot ``at`` gives with these siblings."""
    for beside in proof:
        cut = len(node) * (at % FAN)
        node = hashed(beside[:cut] + node + beside[cut:])
        at //= FAN
    return node


def _levels_of(n: int) -> int | None:
    """Levels to reduce in a block of a group with ``n`` nodes; None: until one is left."""
    return LEVELS if n > BLOCK else None


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Values of ``columns``, then the slots as lists by field, one block unfolded at a time."""
    slots = batch.column("slots")
    for i in range(batch.num_rows):
        fields = slots[i].values
        named = {f.name: fields.field(f.name).to_pylist() for f in fields.type}
        yield (*(batch.column(c)[i].as_py() for c in columns), named)


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [reduced(slots["node"], _levels_of(n))[-1][0] for n, slots in _rows(batch, "n")]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("n"), pa.array(roots, pa.string())], names=["grp", "block", "n", "root"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, idx, up): the siblings from each node of a block to the top of its group."""
    for batch in batches:
        for grp, n, up, slots in _rows(batch, "grp", "n", "up"):
            levels = reduced(slots["node"], _levels_of(n))
            made = [siblings(levels, k) + up for k in range(len(levels[0]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(made), pa.string()), pa.array(slots["idx"], pa.int64()), pa.array(made, pa.list_(pa.string()))],
                names=["grp", "idx", "up"],
            )


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Slot arrays of ``nodes`` (grp, idx, n, node): a row per block of BLOCK consecutive ones."""
    slot = F.struct("idx", "node", *carried)
    return (
        nodes.withColumn("block", F.expr(f"idx DIV {BLOCK}"))
        .groupBy("grp", "block").agg(F.array_sort(F.collect_list(slot)).alias("slots"), F.max("n").alias("n"))
    )


def trees(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From slot arrays of leaves: (grp, root) of every group, and (grp, block, up) with the
    siblings from each of those blocks to its group's top."""
    most = first.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    schema, below, tops, stack = "grp string, block long, n long, root string", first, [], []
    while True:
        roots = staged(below.select("grp", "block", "n", "slots").mapInArrow(_block_roots, schema), "manifest-roots")
        tops.append(roots.where(f"n <= {BLOCK}").select("grp", "root"))
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        nodes = roots.where(f"n > {BLOCK}").select("grp", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) DIV {BLOCK}").alias("n"), F.col("root").alias("node"))
        below = staged(blocks(nodes), "manifest-blocks")
        stack.append(below)
    none = F.array().cast("array<string>")
    up = None
    for level in reversed(stack):
        known = level.where(f"n <= {BLOCK}").withColumn("up", none)
        if up is not None:
            known = known.unionByName(level.where(f"n > {BLOCK}").join(up, ["grp", "block"]))
        up = known.mapInArrow(_paths, "grp string, idx long, up array<string>").withColumnRenamed("idx", "block")
    ups = first.where(f"n <= {BLOCK}").select("grp", "block", none.alias("up"))
    if up is not None:
        ups = ups.unionByName(up)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out, ups


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["grp", "id", "mark", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        for grp, n, up, subroot, at, over, root, slots in _rows(batch, "grp", "n", "up", "subroot", "at", "over", "root"):
            levels = reduced(slots["node"], _levels_of(n))
            proofs, roots = [], []
            for k, (leaf, altered, idx) in enumerate(zip(slots["node"], slots["altered"], slots["idx"])):
                beside = siblings(levels, k) + up
                proofs.append(hashed("".join(beside + over)))
                roots.append(folded(folded(altered or leaf, idx, beside), at, over))
            m = len(proofs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * m, pa.string()), pa.array(slots["id"], pa.int64()), pa.array(slots["mark"], pa.string()), pa.array(slots["node"], pa.string()),
                 pa.array([subroot] * m, pa.string()), pa.array([root] * m, pa.string()), pa.array(proofs, pa.string()),
                 pa.array(roots, pa.string()), pa.array([r == root for r in roots], pa.bool_())],
                names=names,
            )


def prove(leaves: DataFrame) -> DataFrame:
    """A row for each of ``leaves``: grp, id, leaf, subroot, root, proof_sha256 (hash of all
    siblings up to the root), folded_root (from ``altered`` where that is not null, else from
    the leaf) and verified (is that the root?).

    ``leaves``: grp (string) and id (long) name and order a leaf, leaf is its digest. Nulls
    come first in either; rows that repeat an id follow each other by digest, and equal rows
    have places, and so proofs, of their own. No leaves give no rows.
    """
    # null and "" are different groups, and sort in this order
    named = F.coalesce(F.concat(F.lit("."), F.col("grp")), F.lit(""))
    # a null id is below all others; the least long, which would share its place, goes by its digest
    number = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    base = staged(
        leaves.select(named.alias("grp"), number.alias("id"), F.concat(F.when(F.col("id").isNull(), "-").otherwise("."), "leaf").alias("leaf"), "altered"),
        "manifest-leaves",
    )
    nodes = coordinates(base).select("grp", "idx", "n", "id", F.substring("leaf", 2, 64).alias("node"), F.substring("leaf", 1, 1).alias("mark"), "altered")
    first = staged(blocks(nodes, "id", "mark", "altered"), "manifest-blocks")
    tops, ups = trees(first)
    tops = staged(tops, "manifest-tops")

    # the same again over the groups
    count = tops.count()
    order = running(tops.withColumn("one", F.lit(1).cast("long")), ["grp"], "one", "manifest-groups")
    over_nodes = order.select(F.lit("").alias("grp"), F.col("before").alias("idx"), F.lit(count).cast("long").alias("n"), F.col("root").alias("node"), F.col("grp").alias("name"))
    over_first = staged(blocks(over_nodes, "name"), "manifest-over")
    over_tops, over_ups = trees(over_first)
    whole = over_tops.select("root")  # one row, none without leaves
    paths = (
        over_first.join(over_ups, ["grp", "block"])
        .mapInArrow(_over, "grp string, subroot string, at long, over array<string>")
    )
    known = first.join(ups, ["grp", "block"]).join(paths, "grp").withColumn("root", whole.scalar())
    out = known.mapInArrow(_proofs, "grp string, id long, mark string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.select(
        F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias("grp"),
        F.when(F.col("mark") == ".", F.col("id")).alias("id"),
        "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    )


def _over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, subroot, at, over): each group's place among the groups and its siblings there."""
    for batch in batches:
        for n, up, slots in _rows(batch, "n", "up"):
            levels = reduced(slots["node"], _levels_of(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots["name"], pa.string()), pa.array(slots["node"], pa.string()),
                 pa.array(slots["idx"], pa.int64()), pa.array([siblings(levels, k) + up for k in range(len(levels[0]))], pa.list_(pa.string()))],
                names=["grp", "subroot", "at", "over"],
            )
