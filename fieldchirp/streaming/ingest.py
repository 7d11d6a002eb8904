"""Streams: windows into the store, orphans as they arrive, detections per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldchirp.operators.orphans import OrphanState, open_orphans, parent_rows, process_batch, reference_events, snapshot_counts
from fieldchirp.operators.store import first_windows, missing_windows

BUCKETS = 64


def ingest_windows(stream: DataFrame, store: str, checkpoint: str, mode: str = "skip") -> StreamingQuery:
    """Append new windows of a stream to a Parquet store.

    Each batch is written to its own folder, overwritten if the batch is run
    again, so a restart neither loses nor repeats windows.  Windows lie in
    buckets of their file; a batch reads the buckets of its own files only.
    """
    bucket = F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = first_windows(batch)
        try:
            mine = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
            old = spark.read.parquet(store).where((F.col("batch") != epoch) & F.col("bucket").isin(mine))
            new = missing_windows(new, old, mode)
        except Exception as e:  # noqa: BLE001 - the first batch finds no store yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detection_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Detections per class and tumbling window of event time; later ones than the watermark are dropped by it."""
    return stream.withWatermark("start_timestamp", late).groupBy(F.window("start_timestamp", width), "class").agg(F.count("*").alias("n")).select("window.start", "window.end", "class", "n")


class OrphanTracker:
    """Keyed state of references over micro-batches; give ``on_batch`` to foreachBatch or call it with tables."""

    def __init__(self, src: str, ref: tuple[str, str, str], parent: tuple[str, str, str, str | None]) -> None:
        self.src, self.ref, self.parent = src, ref, parent
        self.state = OrphanState()

    def on_batch(self, refs: DataFrame | None, parents: DataFrame | None) -> DataFrame:
        """What the batch changed: new orphans, those it resolved and those it reopened."""
        r = None if refs is None else reference_events(refs, self.src, *self.ref)
        p = None if parents is None else parent_rows(parents, self.src, *self.parent)
        changes, self.state = process_batch(self.state, r, p)
        return changes

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """Orphans open now, per table, month and kind they had on arrival."""
        return snapshot_counts(open_orphans(spark, self.state).withColumn("orphan_kind", F.coalesce("kind", F.lit("deleted"))))


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
