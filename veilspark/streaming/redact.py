"""Redact and gate every record before it is written anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gate import gate, split_gate
from ..operators.redact import redact_rows
from .common import UNTIL_USED_UP


def redact_and_gate(records: DataFrame, text: str = "text") -> DataFrame:
    """Stateless: each record is a scan of its own."""
    body = F.to_json(F.struct(F.array(F.struct(F.col(text).alias("text"))).alias("elements")))
    return gate(redact_rows(records, text).withColumn("payload", body))


def start_gated_sinks(
    records: DataFrame, folder: str, text: str = "text", trigger: dict | None = None
) -> StreamingQuery:
    """Two sinks from one pass: ``passed`` with the redacted text, ``quarantine`` with the
    verdict only. A batch that is run again after a failure overwrites its own output."""
    gated = redact_and_gate(records, text)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            passed, held = split_gate(batch)
            passed.drop("payload", "violations").write.mode("overwrite").parquet(
                f"{folder}/passed/batch={batch_id}"
            )
            held.drop(text, "events").write.mode("overwrite").parquet(
                f"{folder}/quarantine/batch={batch_id}"
            )
        finally:
            batch.unpersist()

    return (
        gated.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or UNTIL_USED_UP))
        .start()
    )
