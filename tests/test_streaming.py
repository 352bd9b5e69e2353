"""Several micro-batches give what one batch gives."""

import os

import pytest
from pyspark.sql import functions as F

from veilspark.operators.redact import redact_rows
from veilspark.operators.sessions import session_steps
from veilspark.plans.actions import loop_records
from veilspark.streaming.common import late_rows, run_to_table, stream_table, write_parquet
from veilspark.streaming.redact import start_gated_sinks
from veilspark.streaming.stateful import first_entries, session_loop, token_registry

FOLDER = "/root/testdata/sf0.001"


def in_files(df, folder, order, n):
    """``df`` in the order of ``order`` as ``n`` files that are taken one after the other."""
    from pyspark.sql import Window

    dealt = df.withColumn("_part", F.ntile(n).over(Window.orderBy(order)))
    for i in range(1, n + 1):
        before = set(folder.glob("part-*"))
        dealt.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(str(folder))
        for file in set(folder.glob("part-*")) - before:
            os.utime(file, (1e9 + i * 10,) * 2)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def late():
    """Up to nine minutes late, within the delay of ten."""
    return (F.unix_micros("ts") + F.pmod(F.xxhash64("ts"), F.lit(540_000_000))).asc()


def passed(df):
    """Rows that the watermark has passed in the end."""
    last = df.agg(F.max(F.unix_millis("ts"))).first()[0] - 600_000
    return df.where(F.unix_millis("ts") <= last)


def test_sessions_over_shuffled_batches(spark, tmp_path):
    """Records of one minute apart come up to nine minutes late, in twelve batches."""
    records = loop_records(spark, FOLDER).withColumn("session_id", F.col("record_id") % 40)
    records = records.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("record_id") * 7))
    assert records.count() > 900
    stream = in_files(records, tmp_path / "in", late(), 12)
    query = write_parquet(session_loop(stream), str(tmp_path / "out"))
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/data")
    want = session_steps(records).select("session_id", "record_id", "step", "stage", "status")
    reached = want.join(passed(records).select("record_id"), "record_id").select(*want.columns)
    assert late_rows(query) == 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, reached.collect()))


def test_sessions_leave_no_state(spark, tmp_path):
    """Ended and unended sessions alike are forgotten when they have been quiet."""
    records = loop_records(spark, FOLDER).where("record_id < 200").withColumn("ts", F.timestamp_seconds(F.col("record_id") + 1_700_000_000))
    other = records.limit(1).withColumn("session_id", F.lit(-1).cast("long")).withColumn("record_id", F.lit(10**6).cast("long"))
    other = other.withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000)))
    stream = in_files(records.unionByName(other), tmp_path / "in", F.col("ts").asc(), 4)
    query = write_parquet(session_loop(stream, forget_minutes=60), str(tmp_path / "out"))
    query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "loop").load(f"{tmp_path}/out/checkpoint")
    assert [r["key"]["session_id"] for r in state.collect()] == [-1]


def test_first_entries_over_shuffled_batches(spark, tmp_path):
    log = spark.range(1500).selectExpr(
        "id % 7 AS scan_id", "concat('el_', id % 5) AS target", "concat('c', id % 3 + id DIV 500 * 10) AS category",
        "timestamp_seconds(1700000000 + id * 3) AS ts",
    )
    stream = in_files(log, tmp_path / "in", late(), 10)
    got = run_to_table(first_entries(stream), "test-first")
    last = log.agg(F.max(F.unix_millis("ts"))).first()[0] - 600_000
    want = log.groupBy("scan_id", "target", "category").agg(F.min("ts").alias("ts")).where(F.unix_millis("ts") <= last)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_registry_over_batches(spark, tmp_path):
    schema = "scan_id long, prefix string, token string, position long, seq int, ts timestamp"
    def part(rows):
        df = spark.createDataFrame(rows, "scan_id long, prefix string, token string, position long, seq int")
        df.withColumn("ts", F.timestamp_seconds("position")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    part([(1, "EMAIL", "b", 2, 0), (1, "EMAIL", "a", 1, 0), (1, "EMAIL", "b", 1, 1), (2, "EMAIL", "a", 1, 0)])
    part([(1, "EMAIL", "a", 3, 0), (1, "EMAIL", "c", 3, 1), (1, "PHONE", "b", 3, 2)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_to_table(token_registry(stream), "test-registry")
    assert sorted(map(tuple, got.collect())) == [
        (1, "EMAIL", "a", 1), (1, "EMAIL", "b", 2), (1, "EMAIL", "c", 3), (1, "PHONE", "b", 1), (2, "EMAIL", "a", 1),
    ]


def test_gated_sinks(spark, tmp_path):
    stream = stream_table(spark, FOLDER, "documents").select("doc_id", "text")
    start_gated_sinks(stream, str(tmp_path)).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/passed/batch=0").select("doc_id", "text")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    want = redact_rows(docs).select("doc_id", "text")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_a_table_of_several_files(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(5).write.parquet(f"{tmp_path}/documents_old.parquet")
    stream = stream_table(spark, str(tmp_path), "documents", files_per_batch=1)
    got = run_to_table(stream, "test-files")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stream_table(spark, str(tmp_path), "document")


def test_numbers_are_not_reissued_after_a_quiet_time(spark, tmp_path):
    schema = "scan_id string, prefix string, token string, position long, seq int, ts timestamp"

    def part(scan, token, minute):
        df = spark.createDataFrame([(scan, "EMAIL", token, 0, 0, minute)], "scan_id string, prefix string, token string, position long, seq int, m long")
        df.select("scan_id", "prefix", "token", "position", "seq", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for file in tmp_path.glob("in/part-*"):  # files are taken by age
            if file.name not in seen:
                seen.append(file.name)
                os.utime(file, (1e9 + len(seen) * 10,) * 2)

    seen: list[str] = []
    for scan, token, minute in (("s", "a", 5), ("t", "x", 10_000), ("t", "y", 20_000), ("s", "b", 30_000)):
        part(scan, token, minute)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_to_table(token_registry(stream, quiet_minutes=60), "test-quiet")
    assert sorted(map(tuple, got.collect())) == [
        ("s", "EMAIL", "a", 1), ("s", "EMAIL", "b", 2), ("t", "EMAIL", "x", 1), ("t", "EMAIL", "y", 2),
    ]
