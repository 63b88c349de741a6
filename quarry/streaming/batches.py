"""Micro-batch form of the atomic batch append (A8 + A9).

The reference sends a batch of rows with ``executemany`` and commits or
rolls back the whole batch.  As a stream: new files landing in a folder are
read with ``readStream``; every micro-batch goes through ``atomic_batch``
(key, NOT NULL and length checks on the executors, then a write and one
version file), so each micro-batch is applied whole or not at all.  The
version records the stream and its micro-batch number, so a micro-batch
replayed after a failure is recognised and not written twice; Spark's
checkpoint in the shared checkpoint folder records progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.changes import atomic_batch, table_schema


def stream_batches(spark: SparkSession, source_dir: str, table_path: str, key=None,
                   lengths: dict | None = None, verdict_path: str | None = None,
                   fmt: str = "parquet", *, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply every file batch arriving in ``source_dir`` to the table.

    Verdicts (batch_id, rule, violations, committed) are appended to
    ``verdict_path`` when given.  ``checkpoint`` names the stream: its batch
    numbers belong to it, so it must be the same folder at every start.  With ``available_now`` the query processes
    what is there and stops (a scheduled job); otherwise it keeps running.
    """
    schema = table_schema(spark, table_path)
    source = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        verdict = atomic_batch(batch.sparkSession, table_path, batch, key, lengths, writer=checkpoint, batch_number=batch_id)
        if verdict_path:
            verdict.select(F.lit(batch_id).cast("long").alias("batch_id"), "*").write.mode(
                "append").parquet(verdict_path)

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
