"""Statistics of distributions, as compositions of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def entropy(df: DataFrame, by: list[str], key: str, weight: Column | None = None) -> DataFrame:
    """Shannon entropy (natural logarithm) of ``key`` within ``by``: ln N - sum(n ln n) / N."""
    n = df.groupBy(*by, key).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("double").alias("n")).where("n > 0")
    return n.groupBy(*by).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def js_divergence(df: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """One row: Jensen-Shannon divergence (natural logarithm) of two weights over ``key`` (G11); null if one is empty."""
    n = df.groupBy(key).agg(F.sum(left).cast("double").alias("a"), F.sum(right).cast("double").alias("b"))
    whole = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p = n.crossJoin(F.broadcast(whole)).select(F.try_divide("a", "ta").alias("p"), F.try_divide("b", "tb").alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / middle)).otherwise(0.0)
    return p.agg(F.when(F.count_if(F.col("p").isNull() | F.col("q").isNull()) == 0, (F.sum(term("p")) + F.sum(term("q"))) / 2).alias("divergence"))


def rate(hit: Column) -> Column:
    """Share of rows for which ``hit`` holds, null for no rows."""
    return F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)))


def signed_sentiment(label: Column) -> Column:
    """+1, -1 or 0; uncertain and unknown labels count for nothing."""
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).when(label.isin("neutral", "mixed"), 0.0)


def distribution(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """A map from key to count per group."""
    n = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))


def merge_distributions(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The sum of map columns over rows."""
    return df.select(*by, F.explode(column).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))
