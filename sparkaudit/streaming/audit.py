"""Document revisions as a stream: every new revision gets the stateless checks once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkaudit.operators.corpus import HYGIENE, Check, counts_to_findings, hygiene_counts


def audit_stream(revisions: DataFrame, event_time: str = "ts", late: str = "1 hour", checks: Sequence[Check] = HYGIENE
                 ) -> DataFrame:
    """Findings of a stream (doc_id, version, text, event time); replays of (doc_id, version) are dropped.

    The state holds one key per revision and expires with the watermark.
    """
    once = revisions.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["doc_id", "version"])
    wide = hygiene_counts(once.withColumn("_id", F.struct("doc_id", "version")), checks, doc_id="_id")
    return counts_to_findings(wide, checks).select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.version").alias("version"), "check", "status", "n")


def start_audit(findings: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append findings as Parquet by check. ``once`` works off what is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch number in the path makes a repeated batch overwrite itself.
        batch.write.mode("overwrite").partitionBy("check").parquet(f"{out}/batch={batch_id}")

    writer = findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
