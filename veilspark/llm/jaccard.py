"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of word n-grams (hashed), a hash of that set and 128 MinHash
   values. Texts with equal sets are one class, whose row with the least id stands for it.
2. Classes that agree on one of 32 bands of four values are candidates. Members of a band
   are dealt in blocks; a task compares two blocks, so no band is ever one task's work, and
   pairs are made inside numpy arrays, never as rows.
3. A pair's values are compared 16 at a time. With a uniform prior on the similarity, the
   posterior after m agreements of n is Beta(m + 1, n - m + 1); a pair is dropped when the
   chance of reaching the threshold falls below ``tolerance``. A pair is taken in the first
   band that it shares only, so it is verified once.
4. What is left is verified on the n-gram sets themselves.

Links are counted per class, and each task reduces its links to a forest of edges, from
which connected components are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import private, slices, staged, text_column
from .words import mix, split, window_hashes

VALUES, BAND, STEP = 128, 4, 16
BLOCK = 256  # members of a band that a task meets at once, twice
PAIRS = 1 << 15  # pairs compared at once
_U64 = np.uint64
_factors = mix(np.arange(1, VALUES + 1, dtype=_U64)) | _U64(1)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and where each text's begin (one more at
    the end). A text of fewer than n words has one, of all its words; without words, none."""
    words = split(texts)
    size = len(words.first) - 1
    count = np.diff(words.first)
    full = np.zeros(0, np.int64)
    if len(words) >= n:
        full = np.flatnonzero(words.doc[: len(words) - n + 1] == words.doc[n - 1 :])
    doc, value = [words.doc[full]], [window_hashes(words.hash, n)[full]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            doc.append(short)
            value.append(window_hashes(words.hash, k)[words.first[short]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]
        doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(size + 1))


def described(texts: pa.Array, n: int):
    """Set sizes, two hashes of each set and its MinHash values (16 bits each, as bytes)."""
    value, first = shingles(texts, n)
    size = np.diff(first)
    some = np.flatnonzero(size)
    a, b = np.zeros(len(size), _U64), np.zeros(len(size), _U64)
    signature = np.zeros((len(size), VALUES), np.uint16)
    if len(some):
        head = first[some]
        a[some] = np.add.reduceat(mix(value), head)
        b[some] = np.add.reduceat(mix(value ^ _U64(0x5851F42D4C957F2D)), head)
        for j in range(VALUES):
            least = np.minimum.reduceat(value * _factors[j], head)
            signature[some, j] = (mix(least) & _U64(0xFFFF)).astype(np.uint16)
    return size, a.view(np.int64), b.view(np.int64), [row.tobytes() for row in signature]


def fewest(threshold: float, tolerance: float) -> list[int]:
    """After each step: agreements below which a pair cannot be hoped for any more."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        below = 0
        # the posterior that the similarity reaches t is the chance of at most m successes
        # in n + 1 trials with probability t
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            below = m + 1
        out.append(below)
    return out


def _surviving(signature: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray, need: list[int]):
    """Pairs that no step drops and that share no earlier band."""
    kept = []
    for i in range(0, len(left), PAIRS):
        a, b, k = left[i : i + PAIRS], right[i : i + PAIRS], band[i : i + PAIRS]
        at = np.arange(i, i + len(a))
        same = np.zeros((len(a), VALUES // BAND), bool)
        agreed = np.zeros(len(a), np.int64)
        for step, least in enumerate(need):
            cut = slice(step * STEP, (step + 1) * STEP)
            equal = signature[a, cut] == signature[b, cut]
            agreed += equal.sum(1)
            same[:, cut.start // BAND : cut.stop // BAND] = equal.reshape(len(a), STEP // BAND, BAND).all(2)
            go = agreed >= least
            a, b, k, at, agreed, same = a[go], b[go], k[go], at[go], agreed[go], same[go]
        kept.append(at[same.argmax(1) == k] if len(at) else at)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _pairs(start: np.ndarray, size: np.ndarray, cross: np.ndarray, side: np.ndarray):
    """Row numbers of all pairs within each group, or between the sides of a cross group."""
    left, right, group = [], [], []
    plain = np.flatnonzero(~cross)
    for s in np.unique(size[plain]):
        if s > 1:
            g = plain[size[plain] == s]
            i, j = np.triu_indices(s, 1)
            left.append((start[g][:, None] + i).ravel())
            right.append((start[g][:, None] + j).ravel())
            group.append(np.repeat(g, len(i)))
    for g in np.flatnonzero(cross):
        rows = np.arange(start[g], start[g] + size[g])
        low, high = rows[side[rows] == 0], rows[side[rows] == 1]
        left.append(np.repeat(low, len(high)))
        right.append(np.tile(high, len(low)))
        group.append(np.full(len(low) * len(high), g))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (left, right, group))


_JOB = pa.schema([("job", pa.int64()), ("keys", pa.list_(pa.int64())), ("pairs", pa.binary())])


def _compare(need: list[int]):
    """Rows (job, band, cross, side, k, signature) sorted by job, to one row for each job that
    keeps a pair: the classes in it and their pairs as packed numbers."""

    def work(table: pa.Table) -> pa.RecordBatch:
        job = table.column("job").to_numpy()
        start = np.flatnonzero(np.r_[True, job[1:] != job[:-1]])
        size = np.diff(np.r_[start, len(job)])
        k, band, side = (table.column(c).to_numpy() for c in ("k", "band", "side"))
        raw = b"".join(table.column("signature").to_pylist())
        signature = np.frombuffer(raw, np.uint16).reshape(-1, VALUES)
        cross = table.column("cross").to_numpy(zero_copy_only=False).astype(bool)[start]
        left, right, group = _pairs(start, size, cross, side)
        kept = _surviving(signature, left, right, band[left], need)
        left, right, group = left[kept], right[kept], group[kept]
        order = np.argsort(group, kind="stable")
        left, right, group = left[order], right[order], group[order]
        jobs, keys, pairs = [], [], []
        for i in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else ():
            j = np.searchsorted(group, group[i], "right")
            rows, at = np.unique(np.r_[left[i:j], right[i:j]], return_inverse=True)
            jobs.append(job[start[group[i]]])
            keys.append(k[rows].tolist())
            pairs.append(at.astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(pairs, pa.binary())], schema=_JOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the last job of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            job = table.column("job").to_numpy()
            last = int(np.flatnonzero(job != job[-1])[-1]) + 1 if job[0] != job[-1] else 0
            if last:
                yield work(table.slice(0, last))
            rest = table.slice(last).combine_chunks()
        if rest is not None and len(rest):
            yield work(rest)

    return run


def _overlaps(value: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of listed pairs of sets."""
    n = len(first) - 1
    if len(left) <= 4 * n or n < 8:
        return np.array([len(np.intersect1d(value[first[i] : first[i + 1]], value[first[j] : first[j + 1]], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((n, n), np.float32)
    width = max(1, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [c, c + width])
        block = np.zeros((n, width), np.float32)
        block[owner[i:j], column[i:j] - c] = 1
        total += block @ block.T
    return total[left, right].astype(np.int64)


def _verify(n: int, threshold: Fraction):
    """Rows (job, k, text, keys, pairs) sorted by job, a job's pairs in the row without a k, to
    (k, links, root): how many links of a class the job holds, and an edge of their forest."""
    schema = pa.schema([("k", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def work(texts: dict[int, str], keys: list[int], pairs: bytes):
        at = np.frombuffer(pairs, "<i4").reshape(2, -1)
        value, first = shingles(pa.array([texts[k] for k in keys], pa.string()), n)
        size = np.diff(first)
        met = _overlaps(value, first, at[0], at[1])
        union = size[at[0]] + size[at[1]] - met
        left, right = at[:, met * threshold.denominator >= union * threshold.numerator]
        links = np.bincount(np.r_[left, right], minlength=len(keys))
        root = np.arange(len(keys))
        while True:  # least neighbour, then shortcut, until nothing changes
            old = root.copy()
            np.minimum.at(root, left, root[right])
            np.minimum.at(root, right, root[left])
            root = root[root]
            if (root == old).all():
                break
        for i in np.flatnonzero(links):
            yield keys[i], int(links[i]), keys[root[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, job = None, {}, None
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("job", "k", "text", "keys", "pairs")]
            for i in range(batch.num_rows):
                number, k = columns[0][i].as_py(), columns[1][i].as_py()
                if number != now:
                    if job:
                        out.extend(work(texts, *job))
                    now, texts, job = number, {}, None
                if k is None:
                    job = columns[3][i].as_py(), columns[4][i].as_py()
                else:
                    texts[k] = columns[2][i].as_py()
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if job:
            out.extend(work(texts, *job))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def row_key(id_col: str, text_col: str):
    """Names a row by id and text; rows that repeat both share it."""
    return F.xxhash64(F.col(id_col).cast("long"), text_column(text_col))


def near_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``; ``class_id`` (least id with the same set of
    n-grams) and ``class_size``; ``n_links`` (other classes whose sets have a Jaccard
    similarity of ``threshold`` or more); ``group_id`` (least id of the connected component);
    and ``row_key`` and ``keep_key`` (``row_key`` of the one row that stands for the group).

    A text of fewer than ``n`` words is one n-gram; texts without words (null, empty) are one
    class without links. Null ids come after all others; a class or group of null ids alone
    has a null id. Rows that repeat id and text share their key. An empty table gives no rows;
    other columns are not carried.

    A link is lost only if its classes share none of the bands (below 1e-7 at similarity 0.8)
    or are pruned wrongly (of the order of ``tolerance``); what is reported is exact.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("k"), text_column(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in slices(batch, "text"):
                part = batch.slice(start, count)
                size, a, b, signature = described(part.column("text"), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("k"), pa.array(size, pa.int64()), pa.array(a), pa.array(b), pa.array(signature, pa.binary())],
                    names=["id", "k", "size", "a", "b", "signature"],
                )

    texts = staged(rows.mapInArrow(describe, "id long, k long, size long, a long, b long, signature binary"), "jaccard-sets")
    marks = ["a", "b", "size"]
    classes = staged(
        texts.groupBy(*marks)
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("rep"),
            F.count("*").alias("class_size"),
            F.first("signature").alias("signature"),
        )
        .select(*marks, F.col("rep.id").alias("class_id"), F.col("rep.k").alias("k"), "class_size", "signature"),
        "jaccard-classes",
    )

    values = classes.where("size > 0").select("k", "signature")
    width = 2 * BAND
    bands = values.select(
        "k",
        F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(VALUES // BAND)])).alias("band", "key"),
    )
    full = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = bands.join(full, "key").join(values, "k").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    own = F.pmod(F.xxhash64("k"), F.col("blocks"))
    dealt = (
        met.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("job"),
            F.col("band").cast("long").alias("band"),
            (F.col("own") != F.col("other")).alias("cross"),
            (F.col("own") > F.col("other")).cast("long").alias("side"),
            "k", "signature",
        )
    )
    jobs = staged(
        dealt.repartition("job")
        .sortWithinPartitions("job")
        .mapInArrow(_compare(fewest(threshold, tolerance)), "job long, keys array<long>, pairs binary"),
        "jaccard-jobs",
    )

    asked = jobs.select("job", F.explode("keys").alias("k"))
    # a merge join at every size: the list of keys grows with the table, so it is never sent
    # to every task, and the plan does not change on the way up
    keys = asked.select("k").distinct().hint("merge")
    wanted = rows.select("k", "text").join(keys, "k", "left_semi").dropDuplicates(["k"])
    work = (
        asked.join(wanted, "k")
        .select("job", "k", "text", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("binary").alias("pairs"))
        .unionByName(jobs.select("job", F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("text"), "keys", "pairs"))
    )
    found = staged(
        work.repartition("job").sortWithinPartitions("job").mapInArrow(_verify(n, Fraction(str(threshold))), "k long, links long, root long"),
        "jaccard-links",
    )
    links = found.groupBy("k").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("k").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "k")
    # the row that stands for a group: least id, nulls last
    placed = classes.select(*marks, "class_id", "class_size", "k").join(links, "k", "left").join(roots, "k", "left")
    placed = placed.withColumn("root", F.coalesce("root", "k"))
    heads = placed.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "k")).alias("head"))
    named = placed.join(heads, "root").select(
        *marks, "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("head.class_id").alias("group_id"), F.col("head.k").alias("keep_key"),
    )
    return texts.select("id", "k", *marks).join(named, marks).select(
        F.col("id").alias(id_col), "class_id", "class_size", "n_links", "group_id", F.col("k").alias("row_key"), "keep_key"
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, whole, one each."""
    key = private(docs, "key")
    stay = near_groups(docs, n, threshold, id_col=id_col, text_col=text_col).where("row_key = keep_key").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
