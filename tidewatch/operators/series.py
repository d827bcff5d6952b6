"""Time series: dense days, trends (A-T1) and drift (A-T2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scoring import trend_status


def dense_days(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """(day, key, value) for every day between the first and the last and every key, 0 where nothing was counted (L3)."""
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = counts.select(key).distinct().crossJoin(F.broadcast(days))  # the keys times the calendar of one range
    return grid.join(counts, [key, "day"], "left").select("day", key, F.coalesce(value, F.lit(0)).alias(value))


def trends(items: DataFrame, key: str, window: int = 7) -> DataFrame:
    """Per key: items of the last ``window`` days against the ones before.

    ``items``: day, key, source_id, language.  The last day is the last one of the items.  Growth is
    (recent - previous) / (previous + 1); acceleration compares the window's halves, the first of window // 2 days.
    """
    last = items.agg(F.max("day").alias("last"))
    aged = items.where(F.col(key).isNotNull()).crossJoin(F.broadcast(last)).withColumn("age", F.datediff("last", "day")).where(F.col("age") < 2 * window)
    late = window - window // 2  # days of the later half
    daily = aged.groupBy(key, "age").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("language").alias("langs"))
    sums = daily.groupBy(key).agg(
        F.sum(F.when(F.col("age") < window, F.col("n")).otherwise(0)).alias("recent"),
        F.sum(F.when(F.col("age") >= window, F.col("n")).otherwise(0)).alias("previous"),
        F.sum(F.when(F.col("age") < late, F.col("n")).otherwise(0)).alias("second_half"),
        F.sum(F.when((F.col("age") >= late) & (F.col("age") < window), F.col("n")).otherwise(0)).alias("first_half"),
        F.max(F.when(F.col("age") < window, F.col("langs")).otherwise(0)).alias("max_daily_languages"),
    )
    by_source = aged.where(F.col("age") < window).groupBy(key, "source_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    spread = by_source.groupBy(key).agg(F.count(F.lit(1)).alias("sources"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("source_entropy"))
    growth = (F.col("recent") - F.col("previous")) / (F.col("previous") + 1)
    acceleration = (F.col("second_half") - F.col("first_half")) / (F.col("first_half") + 1)
    out = sums.join(spread, key, "left").withColumns({"growth": growth, "acceleration": acceleration, "sources": F.coalesce("sources", F.lit(0))})
    return out.select(key, "recent", "previous", F.round("growth", 4).alias("growth"), F.round("acceleration", 4).alias("acceleration"), "sources", F.round(F.coalesce("source_entropy", F.lit(0.0)), 4).alias("source_entropy"), "max_daily_languages", trend_status(F.col("growth"), F.col("recent"), F.col("previous"), F.col("sources")).alias("status"))


def drift(items: DataFrame, metric: str, key: Column, threshold: float, window: int = 7) -> DataFrame:
    """One row: the divergence of ``key`` between the last ``window`` days and the ones before."""
    last = items.agg(F.max("day").alias("last"))
    aged = items.crossJoin(F.broadcast(last)).select(key.alias("key"), F.datediff("last", "day").alias("age")).where(F.col("age") < 2 * window)
    n = aged.where(F.col("key").isNotNull()).groupBy("key").agg(F.count_if(F.col("age") < window).cast("double").alias("a"), F.count_if(F.col("age") >= window).cast("double").alias("b"))
    whole = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p = n.crossJoin(F.broadcast(whole)).where("ta > 0 and tb > 0").select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    value = (F.sum(kl("p")) + F.sum(kl("q"))) / 2
    return p.agg(F.lit(metric).alias("metric"), F.round(value, 5).alias("divergence"), F.coalesce(value > threshold, F.lit(False)).alias("drifted"))
