"""Shared small helpers: reading tables, staging intermediate results, naming columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from veilspark.session import staged

__all__ = ["private", "read", "slices", "staged", "text_column", "with_columns"]

# Arrow batches of texts are worked through in slices of about this many bytes, so that a
# Python worker's memory follows the longest text and not the batch length.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def private(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, **types: str) -> StructType:
    """The schema of ``df`` with columns added; a column of that name is replaced."""
    out = StructType([f for f in df.schema if f.name.lower() not in {n.lower() for n in types}])
    for name, kind in types.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def slices(batch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose texts have about ``most`` bytes together."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start
    pa.default_memory_pool().release_unused()  # workers live on from stage to stage


def text_column(name: str = "text"):
    """The text with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
