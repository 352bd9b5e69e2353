"""Reading tables as streams and running them to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """``name`` as a file stream; new files of the table become new micro-batches.

    A table is a folder ``name.parquet`` of files or one file of that name. If there is
    neither, reading its schema fails, so nothing is taken for an empty stream.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    exact = "".join(f"[{c}]" if c in "*?[]{}" else c for c in f"{name}.parquet")
    return reader.option("pathGlobFilter", exact).parquet(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    """By the file system of the path, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(where).isDirectory()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state of any size lives in RocksDB, with its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


UNTIL_USED_UP = {"availableNow": True}


def write_parquet(stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to ``folder``/data, exactly once. ``trigger`` is what ``writeStream.trigger``
    takes, such as ``{"processingTime": "1 minute"}`` for a stream that lasts; by default
    it runs until the present input is used up."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or UNTIL_USED_UP))
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them and so were left out, over the
    progress reports that are still held."""
    return sum(
        int(state["numRowsDroppedByWatermark"])
        for report in query.recentProgress
        for state in report["stateOperators"]
    )


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all present input and read back what it wrote."""
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    write_parquet(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
