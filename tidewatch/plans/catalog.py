"""Registration of queries with their SQL, and the views that most of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The counting rule in SQL: items that failed in processing don't count.
COUNTED_SQL = "coalesce(processing_status, '') <> 'error'"
ITEMS_SQL = f"(select *, cast(fetched_at as date) as day from articles where {COUNTED_SQL})"


def query(name: str, sql: str | None = None):
    """Registers a query; ``{items}`` in its SQL stands for the items that count."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("{items}", ITEMS_SQL)
        return f

    return add


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The articles that count, with their UTC day."""
    rows = table(spark, folder, "articles").where(F.coalesce("processing_status", F.lit("")) != "error")
    return rows.withColumn("day", F.to_date("fetched_at"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources")
