"""Streaming forms: events once, folded and counted; items classified and routed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.events import exclusion_state


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder, or of a glob, in the order they came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def events_once(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, where repeats come within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rates(stream: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Items per window and key; a window comes out once the watermark has passed it."""
    out = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), key, "n")


def sliding_rates(stream: DataFrame, ts: str, width: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    out = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), (F.col("n") * 60.0 / F.lit(_seconds(width))).alias("per_minute"))


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def last_event(stream: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The state of each key after its last event, updated as events come; for complete or update mode."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("s")).select(key, "s.*")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Drives a bounded input through a stream into a table in memory; for small results and tests."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return spark.table(name)


def fold_to(stream: DataFrame, path: str, checkpoint: str, seq: str = "event_seq") -> StreamingQuery:
    """Keeps the folded exclusion state in ``path``: each batch is appended to the log beside it, and the state written anew from the log."""

    def step(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        log = f"{path}/log"
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(log)
        exclusion_state(batch.sparkSession.read.parquet(log).dropDuplicates([seq])).write.mode("overwrite").parquet(f"{path}/state")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classify_to(stream: DataFrame, path: str, checkpoint: str, label: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Classifies items as they come and writes them by label; a batch written again after a failure replaces itself."""

    def step(batch: DataFrame, epoch: int) -> None:
        out = label(batch).withColumn("epoch", F.lit(epoch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "label").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
