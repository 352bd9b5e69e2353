"""Exact deduplication by progressive refinement.

Length, then a hash of the first characters, then a hash of everything: each level is asked
only of rows that an equal row can still exist for. All of it is DataFrame expressions; each
level is a grouped count that is combined before its shuffle, so a group of any size costs a
task one row. Lists of shared lengths and heads are joined back as tables of keys; adaptive
execution splits a key that holds many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import private, staged

HEAD = 64  # characters under the second hash
BLOCK = 4096  # rows that repeat id and text and are written by one task


def normalised(text: Column) -> Column:
    """Each run of 0x20 and 0x09-0x0D as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _open_heads(light: DataFrame, length: str, head: str) -> DataFrame:
    """(length, head) that more rows than one have. Rows are counted by both before any
    shuffle, so a length that many rows share is a few rows of counts and no hot key; a length
    that one row has can have no such head."""
    return light.groupBy(length, head).count().where("count > 1").select(length, head)


def _unfolded(rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` copies, with ``copy`` from 0. Many copies are dealt out in
    blocks first, so that no task writes them all."""
    few = rows.where(F.col("n") <= BLOCK).select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))
    blocks = (
        rows.where(F.col("n") > BLOCK).select("*", F.explode(F.expr(f"sequence(0L, (n - 1) DIV {BLOCK})")).alias("block"))
        .repartition("digest", "id", "block")
    )
    last = f"least(n, (block + 1) * {BLOCK}) - 1"
    many = blocks.select(*rows.columns, F.explode(F.expr(f"sequence(block * {BLOCK}, {last})")).alias("copy"))
    return few.unionByName(many)


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``keep_id``, ``group_size`` (long),
    ``kept`` and, if ``digests``, ``text_sha256`` of the normalised text.

    Of rows with equal normalised texts the one with the least id is kept; null ids come
    after all others (``keep_id`` is null if all are). Of rows that repeat both id and text
    exactly one is kept. Null and empty texts are equal. An empty table gives no rows; other
    columns are not carried.

    Without ``digests`` the full hash is taken of surviving groups only. With it the caller
    asks for every text's hash, so that is taken in the first scan and used at the last level.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    head = [F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, HEAD)).alias("head")]
    full = F.sha2("norm", 256).alias("digest")
    light = staged(rows.select("id", *head, *[full] * digests), "exact-keys")

    heads = staged(_open_heads(light, "len", "head"), "exact-heads")
    source = light if digests else rows.select("id", *head, "norm")
    open_ = source.join(heads, ["len", "head"], "left_semi")
    open_ = open_.select("id", "len", "head", "digest" if digests else full)

    # a row for each (id, text): what repeats both is counted, not carried
    marks = ["len", "head", "digest"]
    each = open_.groupBy("id", *marks).agg(F.count("*").alias("n"))
    groups = each.groupBy(*marks).agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    decided = _unfolded(each.join(groups, marks).select("id", "keep_id", "group_size", "digest", "n")).select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        "digest",
    )
    single = light.join(heads, ["len", "head"], "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "digest" if digests else F.lit(None).cast("string").alias("digest"),
    )
    out = single.unionByName(decided)
    last = [F.col("digest").alias("text_sha256")] * digests
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", *last)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole; cases as in ``equal_groups``.

    Texts that no other text can equal by length and head stay without a shuffle of their
    own if the list of open heads is small; the rest are grouped by full hash, where a
    group's first row is found by partial aggregation.
    """
    length, head, digest, num = (private(docs, n) for n in ("len", "head", "digest", "id"))
    norm = normalised(F.col(text_col))
    keyed = docs.withColumns({length: F.octet_length(norm), head: F.xxhash64(F.substring(norm, 1, HEAD))})
    light = staged(keyed.select(length, head), "exact-keys")
    heads = staged(_open_heads(light, length, head), "exact-heads")
    single = keyed.join(heads, [length, head], "left_anti").select(*docs.columns)
    open_ = keyed.join(heads, [length, head], "left_semi").select(
        *docs.columns, F.sha2(norm, 256).alias(digest), F.col(id_col).cast("long").alias(num)
    )
    whole = F.struct(*[F.col(c) for c in docs.columns])
    # nulls last: a null id gives way to any other
    first = (
        open_.groupBy(digest)
        .agg(F.min_by(whole, F.struct(F.col(num).isNull(), F.col(num))).alias("row"))
        .select("row.*")
    )
    return single.unionByName(first)
