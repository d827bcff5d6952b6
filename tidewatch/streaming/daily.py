"""The batch computations as streams: windows with late data, deduplication, micro-batches (2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources.sinks import overwrite_days

LATE = "3 days"  # how long late items are waited for


def item_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Items that arrive as Parquet files, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def clamp_future(stream: DataFrame, at: str = "fetched_at") -> DataFrame:
    """Items dated more than six hours ahead count from now."""
    return stream.withColumn(at, F.when(F.col(at) > F.current_timestamp() + F.expr("interval 6 hours"), F.current_timestamp()).otherwise(F.col(at)))


def windowed_counts(stream: DataFrame, at: str, key: str, length: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Items per window and key, tumbling or sliding."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once_per_key(stream: DataFrame, key: str, at: str, late: str = LATE) -> DataFrame:
    """The first item of each key within the time that late items are waited for."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, at: str, key: str, gap: str = "48 hours", late: str = LATE) -> DataFrame:
    """Runs of items of one key without a longer gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_into(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, exactly once, into Parquet; a restart goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def recompute_days(stream: DataFrame, items_path: str, sink: str, checkpoint: str, at: str = "fetched_at") -> StreamingQuery:
    """Adds each micro-batch to the items and computes again the days it touches; repeating a batch changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumns({"day": F.to_date(at), "batch_id": F.lit(number)}).where("day is not null")
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(items_path)
        days = [r[0] for r in dated.select("day").distinct().collect()]
        if days:  # only the folders of these days are read
            again = spark.read.parquet(items_path).where(F.col("day").isin(days))
            overwrite_days(again.groupBy("day").agg(F.count(F.lit(1)).alias("n")), sink)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
