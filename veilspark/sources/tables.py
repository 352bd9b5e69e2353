"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD = "spark.veilspark.spread"
ROWS_A_TASK = 4096  # of a small table whose rows become forms, pages or images


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out the rows of a file or two to ``spark.veilspark.spread`` partitions.

    Only sessions over small files set that (``local_session`` does); without it, and so
    on a cluster, no shuffle is added. With ``keys``, a later grouping by them needs no
    second shuffle.
    """
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts, *keys) if parts else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out short rows, each of which stands for much work, ``ROWS_A_TASK`` to a task.

    A file of a million such rows takes a few megabytes, so it is one split or two; what is
    made from them would all be made there. The rows are counted (parquet keeps that in its
    footers) and shuffled as they are, before anything is made from them. With ``keys``, a
    later grouping by them needs no second shuffle.
    """
    spark = df.sparkSession
    least = int(spark.conf.get(SPREAD, "0")) or spark.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // ROWS_A_TASK)), *keys)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A document is a scan of one text."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation is a scan; each turn is one text element of it."""
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page is a scan: its address and its markup."""
    return spread(table(spark, folder, "pages").select("page_id", "url", "html"))


def text_elements(df: DataFrame, scan: str, position: str, text: str = "text") -> DataFrame:
    """Any free text as element rows of tag ``p``."""
    return df.select(
        F.col(scan).alias("scan_id"),
        F.col(position).alias("ord"),
        F.format_string("el_%03d", F.col(position) + 1).alias("id"),
        F.lit("p").alias("tag"),
        F.lit("text block").alias("type"),
        F.col(text).alias("text"),
        F.lit(False).alias("sensitive"),
    )
