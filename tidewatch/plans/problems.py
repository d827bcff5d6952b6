"""Queries of the general problems over the data folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators.asof import as_known
from tidewatch.operators.history import GONE, build_history, canonical_label, canonical_numbers
from tidewatch.operators.instants import resolve_instants
from tidewatch.tables import table


_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"


def _dated(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    zones = table(spark, folder, "sources").groupBy("source_id").agg(F.min("time_zone").alias("time_zone"))
    rows = table(spark, folder, name).select(F.concat(F.lit(f"{name}:"), F.col(key)).alias("row_key"), "source_id", "fetched_at", "published_at")
    return rows.where(F.col("published_at").isNotNull() & F.col("row_key").isNotNull()).join(zones, "source_id", "left")


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    """The instants of both tables; a source keeps one order of day and month over both."""
    records = _dated(spark, folder, "raw_items", "item_id").unionByName(_dated(spark, folder, "articles", "article_id"))
    split = F.split("row_key", ":")
    return resolve_instants(records).select(split[0].alias("table_name"), split[1].cast("long").alias("row_id"), "instant_us")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The instant that each published_at denotes."""
    return _instants(spark, folder).distinct()


def p6_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The instants of the values that are written with zone Z, which SQL reads as well; the operator gets all values."""
    plain = table(spark, folder, "raw_items").where(F.col("published_at").rlike(_PLAIN)).select(F.col("item_id").alias("row_id"))
    return _instants(spark, folder).where("table_name = 'raw_items'").join(plain, "row_id", "left_semi").select("row_id", "instant_us")


def _recorded(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """The orientation row that held at each event (event_id, entity_id, instant_us), as recorded by then."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    history = table(spark, folder, "source_orientation").select(
        F.col("orientation_id").alias("version_id"),
        F.col("source_id").alias("entity_id"),
        # It counts from when it was recorded and valid, to when its end has come and was recorded.
        F.greatest(us("created_at"), F.coalesce(us("valid_from"), us("created_at"))).alias("start_us"),
        F.when(F.col("valid_to").isNotNull() & F.col("closed_at").isNotNull(), F.greatest(us("valid_to"), us("closed_at"))).alias("end_us"),
        us("created_at").alias("recorded_us"),
    )
    return as_known(events, history).select(F.col("event_id").alias("article_id"), F.col("version_id").alias("orientation_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The orientation row of each article's source that held when it was published, as recorded by then."""
    instants = _instants(spark, folder).where("table_name = 'articles'").select(F.col("row_id").alias("event_id"), "instant_us")
    owners = table(spark, folder, "articles").select(F.col("article_id").cast("long").alias("event_id"), F.col("source_id").alias("entity_id"))
    return _recorded(spark, folder, instants.join(owners, "event_id").select("event_id", "entity_id", "instant_us"))


def p1_at_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """The same when it was fetched, an instant that SQL knows."""
    return _recorded(spark, folder, table(spark, folder, "articles").select(F.col("article_id").cast("long").alias("event_id"), F.col("source_id").alias("entity_id"), F.unix_micros("fetched_at").alias("instant_us")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The versions of each source's orientation over the deliveries."""
    rows = table(spark, folder, "orientation_snapshots")
    label = canonical_label(F.col("simplified"))
    archived = F.coalesce(F.lower(F.trim("registry_status")) == "archived", F.lit(False))
    payload = F.when(archived, F.lit(GONE)).otherwise(F.concat_ws("\t", label, canonical_numbers(F.col("dimensions"))))
    deliveries = rows.select(F.col("source_id").alias("entity_id"), F.col("snapshot_date").alias("day"), "loaded_at", label.alias("label"), payload.alias("payload"))
    return build_history(deliveries).select(F.col("entity_id").cast("int").alias("source_id"), "valid_from", "valid_to", F.col("label").alias("simplified"))


QUERIES = {"p1_found": p1_found, "p1_at_fetch": p1_at_fetch, "p5_found": p5_found, "p6_found": p6_found, "p6_plain": p6_plain}

ORACLES = {
    "p1_at_fetch": """select article_id, orientation_id from articles a join source_orientation o using (source_id)
where o.created_at <= a.fetched_at and (valid_from is null or valid_from <= cast(a.fetched_at as date)) and (valid_to is null or valid_to > cast(a.fetched_at as date) or closed_at is null or closed_at > a.fetched_at)
qualify row_number() over (partition by article_id order by o.created_at desc, orientation_id desc) = 1""",
    "p6_plain": f"select item_id as row_id, epoch_us(cast(replace(replace(published_at, 'T', ' '), 'Z', '') as timestamp)) as instant_us from raw_items where regexp_matches(published_at, '{_PLAIN}')",
    "p5_found": r"""
with latest as (
  select source_id, snapshot_date,
    case when coalesce(trim(simplified), '') = '' then 'unknown' else lower(trim(simplified)) end as label,
    coalesce((select string_agg(k || '=' || cast(v as double)::varchar, ',' order by k)
              from (select unnest(json_keys(dimensions)) as k,
                           unnest(list_transform(json_keys(dimensions), lambda q: json_extract_string(dimensions, '$.' || q))) as v)), '') as dims,
    coalesce(lower(trim(registry_status)) = 'archived', false) as gone,
    row_number() over (partition by source_id, snapshot_date order by loaded_at desc) as rn
  from orientation_snapshots),
steps as (
  select source_id, snapshot_date, label, case when gone then 'GONE' else label || dims end as payload from latest where rn = 1),
marked as (
  select *, lag(payload) over (partition by source_id order by snapshot_date) as before from steps),
changes as (
  select *, lead(snapshot_date) over (partition by source_id order by snapshot_date) as until from marked where before is distinct from payload)
select source_id, strftime(snapshot_date, '%Y-%m-%d') as valid_from, coalesce(strftime(until, '%Y-%m-%d'), '') as valid_to, label as simplified
from changes where payload <> 'GONE'""",
}
