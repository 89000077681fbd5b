"""Streaming counterparts: deliveries as they arrive, upserts of whatever they change. An extension, not a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.events import KEY, conflicts, normalize, payload_hash


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet deliveries as a stream; bounded work in flight by files for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, arrival: str = "received_ts", late: str = "7 days") -> DataFrame:
    """Each payload of each event once within the watermark; a conflicting payload passes, so the reader sees the conflict."""
    d = stream.withColumn("__payload", payload_hash()).withWatermark(arrival, late)
    return d.dropDuplicatesWithinWatermark([*KEY, "__payload"]).drop("__payload")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n): tumbling counts that close when the watermark passes."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): sessions by inactivity gap."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def upsert_journal(stream: DataFrame, journal: str, checkpoint: str) -> StreamingQuery:
    """Append every batch of call records under its batch id; a replayed batch overwrites its own part, so nothing doubles.

    The journal's current state is journal.latest() over all parts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{journal}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def changed_traces(stream: DataFrame, store: str, out: str, checkpoint: str, build) -> StreamingQuery:
    """Rebuild the traces that a batch touches from all their deliveries, late parents included, and write them as upserts.

    store keeps all deliveries by batch; build(events) makes the rows of whole traces; readers take the highest batch of a key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        touched = batch.select("tenant_id", "trace_id").distinct()
        whole = spark.read.option("basePath", store).parquet(store).filter(F.col("batch") <= batch_id).join(touched, ["tenant_id", "trace_id"], "left_semi").drop("batch")
        build(whole).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def split_conflicts(stream: DataFrame, store: str, out: str, conflicts_out: str, checkpoint: str) -> StreamingQuery:
    """Events as they arrive, with a side output: each batch upserts the events it touches, those with conflicting deliveries go to conflicts_out.

    Deliveries of all batches so far decide, so a conflict is seen however far apart the deliveries are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        touched = batch.select(*KEY).distinct()
        whole = spark.read.option("basePath", store).parquet(store).filter(F.col("batch") <= batch_id).join(touched, list(KEY), "left_semi").drop("batch")
        conflicts(whole).write.mode("overwrite").parquet(f"{conflicts_out}/batch={batch_id}")
        normalize(whole).filter("NOT conflicting").drop("conflicting").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """(batch, rows, seconds) of the batches that the query has run."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000} for p in query.recentProgress]
