"""Streaming batches land whole or not at all."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import work_path
from quarry.sources import changes as C
from quarry.streaming.batches import stream_batches

SCHEMA = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("s", T.StringType(), True)])


def test_stream_batches(spark):
    table = work_path(spark, "stream-table")
    src = work_path(spark, "stream-src")
    verdicts = work_path(spark, "stream-verdicts")
    ckpt = work_path(spark, "stream-ckpt")
    C.create_table(spark, table, SCHEMA)
    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).write.mode("append").parquet(src)
    q = stream_batches(spark, src, table, key=["k"], lengths={"s": "char(1)"}, verdict_path=verdicts,
                       checkpoint=ckpt)
    q.awaitTermination()
    assert sorted(r.k for r in C.read_table(spark, table).collect()) == [1, 2]
    # second run: a batch with a repeated key is refused as a whole
    spark.createDataFrame([(3, "c"), (1, "z")], SCHEMA).write.mode("append").parquet(src)
    q2 = stream_batches(spark, src, table, key=["k"], lengths={"s": "char(1)"}, verdict_path=verdicts,
                        checkpoint=ckpt)
    q2.awaitTermination()
    rows = sorted(r.k for r in C.read_table(spark, table).collect())
    assert rows == [1, 2]
    v = spark.read.parquet(verdicts)
    assert v.filter((F.col("rule") == "primary_key") & (F.col("violations") > 0)).count() >= 1


def test_replayed_batch_is_not_written_twice(spark):
    table = work_path(spark, "replay-table")
    C.create_table(spark, table, SCHEMA)
    batch = spark.createDataFrame([(1, "a")], SCHEMA)
    C.atomic_batch(spark, table, batch, key=["k"], writer="w", batch_number=0)
    C.atomic_batch(spark, table, batch, key=None, writer="w", batch_number=0)
    assert C.read_table(spark, table).count() == 1


def test_stream_bayes_update_matches_batch(spark):
    from quarry.operators import stats as H
    from quarry.plans.q_stats import segment_model
    from quarry.sources.tables import load
    from quarry.streaming.bayes import stream_bayes_update
    from tests.conftest import SF001

    priors_df, lik_df = segment_model(spark, SF001)
    priors = {r.hypothesis: r.prior for r in priors_df.collect()}
    lik = {(r.hypothesis, r.event_type): r.likelihood for r in lik_df.collect()}
    events = load(spark, SF001, "events")
    # the events arrive as three time-ordered files, one per micro-batch
    src = work_path(spark, "bayes-src")
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for i in range(3):
        events.filter((F.col("ts") >= F.lit(bounds[i]).cast("timestamp_ntz"))
                      & (F.col("ts") < F.lit(bounds[i + 1]).cast("timestamp_ntz"))).coalesce(1) \
            .write.parquet(f"{src}/part{i}")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = stream_bayes_update(stream, "user_id", ["ts", "event_id"], "event_type", priors, lik, "event_id")
    sink = work_path(spark, "bayes-out")
    q = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", work_path(spark, "bayes-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.event_id, r.hypothesis): r.posterior for r in spark.read.parquet(sink).collect()}
    ref = H.bayes_update(events, "user_id", ["ts", "event_id"], "event_type", priors_df, lik_df,
                         id_cols=["event_id"]).collect()
    assert len(got) == len(ref)
    assert max(abs(got[(r.event_id, r.hypothesis)] - r.posterior) for r in ref) < 1e-9
