"""Ingest gates, upserts, histories and exports over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scoring import fetch_class, relevance
from tidewatch.functions.urls import domain_of
from tidewatch.operators.filters import gate
from tidewatch.plans.analysis import hits_sql
from tidewatch.plans.catalog import items, query, sources
from tidewatch.sources.sinks import archive_missing, as_json, bibtex, citation_key, classify_upsert, close_and_open, guard_formula, mark_current, ris
from tidewatch.tables import table


@query(
    "publisher_attribution",
    r"""with s as (select domain, min(source_id) as sid from sources where source_type <> 'social_account' group by 1),
    u as (select item_id, source_id, lower(publisher_domain) as pd, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', ''), '^m\.', '') as ud from raw_items)
    select item_id, coalesce(a.sid, b.sid, u.source_id) as source_id from u left join s a on a.domain = u.pd left join s b on b.domain = u.ud""",
)
def publisher_attribution(spark, folder):
    """The source an item belongs to, by its publisher's domain, then its address."""
    s = sources(spark, folder).where("source_type <> 'social_account'").groupBy("domain").agg(F.min("source_id").alias("sid"))
    r = table(spark, folder, "raw_items").select("item_id", "source_id", F.lower("publisher_domain").alias("pd"), domain_of(F.col("url")).alias("ud"))
    joined = r.join(s.select(F.col("domain").alias("pd"), F.col("sid").alias("a")), "pd", "left").join(s.select(F.col("domain").alias("ud"), F.col("sid").alias("b")), "ud", "left")
    return joined.select("item_id", F.coalesce("a", "b", "source_id").alias("source_id"))


@query(
    "item_upsert",
    """with r as (select url, md5(coalesce(title, '') || '|' || coalesce(summary, '')) as h, fetched_at from raw_items where url is not null),
    o as (select url, max(h) as h from r where fetched_at < timestamp '2025-10-01' group by 1), n as (select url, max(h) as h from r where fetched_at >= timestamp '2025-10-01' group by 1)
    select case when o.url is null then 'insert' when n.url is null then 'kept' when o.h = n.h then 'unchanged' else 'update' end as action, count(*) as n from o full join n using (url) group by 1""",
)
def item_upsert(spark, folder):
    """What the deliveries since October do to the items before (K1)."""
    h = F.md5(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    r = table(spark, folder, "raw_items").where("url is not null").select("url", h.alias("h"), "fetched_at")
    late = F.col("fetched_at") >= F.lit("2025-10-01").cast("timestamp")
    classified = classify_upsert(r.where(~late).groupBy("url").agg(F.max("h").alias("h")), r.where(late).select("url", "h"), "url", "h")
    return classified.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "current_orientation",
    """select source_id, orientation_id from (select *, row_number() over (partition by source_id order by created_at desc, orientation_id desc) as n from source_orientation) where n = 1""",
)
def current_orientation(spark, folder):
    """The current row of each source (K3)."""
    o = table(spark, folder, "source_orientation").withColumn("version", F.struct("created_at", "orientation_id"))
    return mark_current(o, ["source_id"], "version").where("is_current").select("source_id", "orientation_id")


@query(
    "orientation_scd2",
    """with h as (select source_id, min_by(simplified, orientation_id) as s from source_orientation where valid_to is null and simplified is not null group by 1), t as (select source_id, min_by(simplified, loaded_at) as s from orientation_snapshots where snapshot_date = (select max(snapshot_date) from orientation_snapshots) and simplified is not null group by 1)
    select source_id, h.s as simplified, (t.s is null or t.s = h.s) as open from h left join t using (source_id) union all select source_id, t.s, true from t left join h using (source_id) where h.s is null or h.s <> t.s""",
)
def orientation_scd2(spark, folder):
    """Open rows of the history closed and opened by the last delivery (K4)."""
    h = table(spark, folder, "source_orientation").where("valid_to is null and simplified is not null").groupBy("source_id").agg(F.min_by("simplified", "orientation_id").alias("simplified"))
    h = h.select("source_id", "simplified", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    s = table(spark, folder, "orientation_snapshots")
    last = s.agg(F.max("snapshot_date").alias("snapshot_date"))
    t = s.join(F.broadcast(last), "snapshot_date").where("simplified is not null").groupBy("source_id").agg(F.min_by("simplified", "loaded_at").alias("simplified"))
    return close_and_open(h, t, "source_id", ["simplified"], F.lit("2026-12-31").cast("date")).select("source_id", "simplified", F.col("valid_to").isNull().alias("open"))


@query("archived_sources", "select source_id, case when source_id in (select source_id from orientation_snapshots) then 'curated' else 'archived' end as status from sources")
def archived_sources(spark, folder):
    """Sources that the registry has no more are archived (K5)."""
    return archive_missing(sources(spark, folder).select("source_id"), table(spark, folder, "orientation_snapshots").select("source_id"), "source_id")


@query(
    "export_rows",
    """with m as (select article_id, array_to_string(list_sort(list(distinct e.slug)), ';') as actors from entity_mentions m join entities e using (entity_id) group by 1)
    select a.article_id, s.slug as source, s.operating_base as base, a.day, a.language, a.primary_category as category, a.sentiment, coalesce(m.actors, '') as actors,
    case when regexp_matches(a.title, '^[=+\\-@\\t\\r]') then '''' || a.title else a.title end as title from {items} a join sources s using (source_id) left join m using (article_id)""",
)
def export_rows(spark, folder):
    """Rows for export, actors in one sorted field, formulas guarded (Q23, K6)."""
    m = table(spark, folder, "entity_mentions").join(table(spark, folder, "entities").select("entity_id", F.col("slug").alias("actor")), "entity_id").groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("actor")), ";").alias("actors"))
    a = items(spark, folder).join(sources(spark, folder).select("source_id", F.col("slug").alias("source"), F.col("operating_base").alias("base")), "source_id").join(m, "article_id", "left")
    return a.select("article_id", "source", "base", "day", "language", F.col("primary_category").alias("category"), "sentiment", F.coalesce("actors", F.lit("")).alias("actors"), guard_formula(F.col("title")).alias("title"))


def _cited(spark, folder):
    a = items(spark, folder).join(sources(spark, folder).select("source_id", F.col("slug").alias("source")), "source_id")
    return a, {c: F.col(c) for c in ("title", "source", "day", "url", "language", "is_demo", "excerpt")}


_KEY_SQL = """substring(regexp_replace(lower(s.slug), '[^a-z0-9]', '', 'g'), 1, 15) || strftime(a.day, '%Y')
    || coalesce(nullif(substring(regexp_replace(string_split_regex(trim(case when coalesce(a.title, '') = '' then 'x' else a.title end), '\\s+')[1], '[^\\p{L}\\p{N}\\p{M}_]+', '', 'g'), 1, 12), ''), 'item') || article_id"""


@query(
    "export_citations",
    f"""select article_id, {_KEY_SQL} as key,
    'TY  - NEWS' || chr(10) || 'TI  - ' || coalesce(a.title, '') || chr(10) || 'T2  - ' || s.slug || chr(10) || 'PY  - ' || strftime(a.day, '%Y') || chr(10) || 'DA  - ' || strftime(a.day, '%Y/%m/%d') || chr(10) || 'UR  - ' || coalesce(a.url, '') || chr(10)
    || 'LA  - ' || coalesce(a.language, '') || chr(10) || 'Y2  - 2026-12-31' || case when coalesce(a.excerpt, '') <> '' then chr(10) || 'AB  - ' || a.excerpt else '' end || case when a.is_demo then chr(10) || 'N1  - DEMO DATA (synthetic record)' else '' end || chr(10) || 'ER  - ' as ris
    from {{items}} a join sources s using (source_id)""",
)
def export_citations(spark, folder):
    """Citation keys and RIS records (K8)."""
    a, row = _cited(spark, folder)
    return a.select("article_id", citation_key(F.col("source"), F.col("day"), F.col("title"), F.col("article_id")).alias("key"), ris(row, F.lit("2026-12-31").cast("date")).alias("ris"))


@query("export_bibtex")
def export_bibtex(spark, folder):
    """BibTeX entries (K8), tested on a fixture."""
    a, row = _cited(spark, folder)
    key = citation_key(F.col("source"), F.col("day"), F.col("title"), F.col("article_id"))
    return a.select("article_id", bibtex(key, row, F.lit("2026-12-31").cast("date"), "Retrieved via Tidewatch").alias("entry"))


@query("export_json")
def export_json(spark, folder):
    """One JSON text per item with the filters (K7)."""
    return as_json(items(spark, folder).select("article_id", "title", "language"), "all", True)


@query(
    "fetch_classes",
    """select event_type, case when k between 200 and 299 then 'ok' when k = 304 then 'unchanged' when k = 429 then 'rate_limited' when k in (401, 403, 451) then 'blocked' when k in (404, 410) then 'gone' when k in (408, 425) or k >= 500 then 'retry' when k is null then 'unreachable' else 'failed' end as class, count(*) as n
    from (select event_type, 200 + (event_id % 400) as k from events) group by 1, 2""",
)
def fetch_classes(spark, folder):
    """Classes of answers (S7); event ids stand for status codes."""
    e = table(spark, folder, "events").select("event_type", fetch_class(200 + F.col("event_id") % 400).alias("class"))
    return e.groupBy("event_type", "class").agg(F.count(F.lit(1)).alias("n"))


_DATED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


@query(
    "ingest_gate",
    f"""with n as (select max(fetched_at) as now from raw_items), r as (select item_id, coalesce(source_type = 'agency', false) as aggregator, now, {hits_sql("r.title", ["ferry", "bridge toll"])} as st, {hits_sql("r.summary", ["ferry", "bridge toll"])} as ss,
      {hits_sql("concat_ws(' ', r.title, r.summary)", ["council"])} as w, case when regexp_matches(published_at, '{_DATED}') then try_cast(replace(published_at, 'Z', '') as timestamp) end as p from raw_items r left join sources using (source_id) cross join n),
    c as (select *, case when p > now + interval 6 hour then now else p end as q, case when st > 0 then 1.0 when ss > 0 then 0.8 when w > 0 then 0.4 else 0.0 end as rel from r)
    select item_id, case when q < now - interval 90 day then 'old' when not aggregator and rel < 0.75 then 'irrelevant' else 'kept' end as decision, epoch_us(coalesce(q, now)) as published_us, p is null as estimated,
    case when aggregator and rel = 0 then 0.6 else rel end::double as relevance from c""",
)
def ingest_gate(spark, folder):
    """Which delivered items are stored, and with what date and relevance (F10); agencies stand for aggregators."""
    r = table(spark, folder, "raw_items").join(sources(spark, folder).select("source_id", "source_type"), "source_id", "left")
    now = r.agg(F.max("fetched_at").alias("now"))
    dated = F.when(F.col("published_at").rlike(_DATED), F.try_to_timestamp("published_at"))
    rows = r.crossJoin(F.broadcast(now)).select("item_id", dated.alias("published"), "now", F.coalesce(F.col("source_type") == "agency", F.lit(False)).alias("aggregator"), relevance(F.col("title"), F.col("summary"), ["ferry", "bridge toll"], ["council"]).alias("relevance"))
    return gate(rows, 90).select("item_id", "decision", F.unix_micros("published_at").alias("published_us"), "estimated", "relevance")
