"""Registry checks, model and run overviews, topic profiles (C4, C5, G16, N4, T19, A-T10, A-R1, Q02, Q09, Q11, Q24-Q28)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.functions.scoring import health, one_of, only_with, record_problems, run_status, with_default
from tidewatch.functions.stats import rate
from tidewatch.functions.text import key_hash
from tidewatch.operators.lexicon import with_prototypes
from tidewatch.operators.topics import corpus
from tidewatch.plans.catalog import items, query, sources
from tidewatch.plans.metrics import PARENT_SQL, parent_of, timeline
from tidewatch.tables import table

TYPES = ["tv", "agency", "website", "newspaper", "social_account"]
CONTENT = {"tv": "video", "agency": "text", "newspaper": "text", "social_account": "post"}


@query(
    "registry_problems",
    """select source_id, array_to_string(list_filter([case when coalesce(trim(name), '') = '' then 'no name' end, case when not coalesce(source_type in ('tv', 'agency', 'website', 'newspaper', 'social_account'), false) then 'unknown type' end,
      case when coalesce(country, '') = '' then 'no country' end, case when tier is not null and not coalesce(classification_confidence >= 0.5, false) then 'tier without confidence' end,
      case when coverage_area is not null and coalesce(trim(operating_base), '') = '' then 'area without base' end, case when not coalesce(len(languages) > 0, false) then 'no language' end,
      case when not coalesce(regexp_matches(domain, '^[a-z0-9.-]+$'), false) then 'bad domain' end], lambda x: x is not null), ', ') as problems from sources""",
)
def registry_problems(spark, folder):
    """What is wrong with each record of the registry (C4)."""
    c = F.col
    checks = {
        "no name": F.trim("name") != "", "unknown type": one_of(c("source_type"), TYPES), "no country": c("country") != "",
        "tier without confidence": c("tier").isNull() | (c("classification_confidence") >= 0.5), "area without base": only_with(c("coverage_area"), c("operating_base")),
        "no language": F.size("languages") > 0, "bad domain": c("domain").rlike("^[a-z0-9.-]+$"),
    }
    return sources(spark, folder).select("source_id", F.array_join(record_problems(checks), ", ").alias("problems"))


@query("registry_defaults", "select source_id, coalesce(case source_type when 'tv' then 'video' when 'agency' then 'text' when 'newspaper' then 'text' when 'social_account' then 'post' end, 'mixed') as content, coalesce(nullif(trim(coverage_area), ''), operating_base, 'unknown') as area from sources")
def registry_defaults(spark, folder):
    """Defaults of records by their other attributes."""
    area = F.coalesce(F.when(F.trim("coverage_area") != "", F.trim("coverage_area")), "operating_base", F.lit("unknown"))
    return sources(spark, folder).select("source_id", with_default(F.lit(""), F.col("source_type"), CONTENT, "mixed").alias("content"), area.alias("area"))


@query(
    "registry_check",
    """with d as (select domain, count(*) as records, min(source_id) as first from sources where source_type <> 'social_account' group by 1),
    seen as (select lower(publisher_domain) as domain, count(*) as items from raw_items where publisher_domain is not null group by 1)
    select coalesce(d.domain, seen.domain) as domain, case when seen.domain is null then 'unseen' when d.domain is null then 'candidate' when d.records > 1 then 'ambiguous' else 'verified' end as status,
      case when d.records = 1 then d.first end as source_id, coalesce(seen.items, 0) as items from d full join seen on d.domain = seen.domain""",
)
def registry_check(spark, folder):
    """Records matched to what is delivered by their domain, a hard identifier; ambiguous ones are left alone (A-R1)."""
    d = sources(spark, folder).where("source_type <> 'social_account'").groupBy("domain").agg(F.count(F.lit(1)).alias("records"), F.min("source_id").alias("first"))
    seen = table(spark, folder, "raw_items").where("publisher_domain is not null").groupBy(F.lower("publisher_domain").alias("domain")).agg(F.count(F.lit(1)).alias("items"))
    status = F.when(F.col("items").isNull(), "unseen").when(F.col("records").isNull(), "candidate").when(F.col("records") > 1, "ambiguous").otherwise("verified")
    return d.join(seen, "domain", "full").select("domain", status.alias("status"), F.when(F.col("records") == 1, F.col("first")).alias("source_id"), F.coalesce("items", F.lit(0)).alias("items"))


@query("key_hashes", "select source_id, sha256(slug) as key_hash from sources")
def key_hashes(spark, folder):
    """Hashes of keys (T19); slugs stand for keys."""
    return sources(spark, folder).select("source_id", key_hash(F.col("slug")).alias("key_hash"))


@query(
    "model_totals",
    """with l as (select max(ts) as last from events) select event_type, count(*) as calls, coalesce(round(sum(value), 4), 0) as spent, coalesce(round(sum(value) filter (where ts >= last - interval 30 day), 4), 0) as spent_30d,
    count(*) filter (where ts >= last - interval 30 day and value < 10) as low_30d from events cross join l group by 1""",
)
def model_totals(spark, folder):
    """Calls and sums per model, in all and over 30 days (G16, Q26); the stream table stands for calls."""
    e = table(spark, folder, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last"))))
    late = F.col("ts") >= F.col("last") - F.expr("interval 30 days")
    total = lambda c: F.coalesce(F.round(F.sum(c), 4), F.lit(0.0))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), total("value").alias("spent"), total(F.when(late, F.col("value"))).alias("spent_30d"), F.count_if(late & (F.col("value") < 10)).alias("low_30d"))


@query(
    "run_overview",
    """with r as (select batch_no, count(*) as items, count(*) filter (where processing_status = 'error') as errors from articles group by 1)
    select batch_no, items, errors, case when errors > 0 and items = errors then 'failed' when errors > 0 then 'partial' else 'success' end as status from r""",
)
def run_overview(spark, folder):
    """Runs with the number of their errors (Q28, C7); batches are the runs."""
    r = table(spark, folder, "articles").groupBy("batch_no").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("processing_status") == "error").alias("errors"))
    return r.select("batch_no", "items", "errors", run_status(F.col("errors"), F.col("items") - F.col("errors")).alias("status"))


@query(
    "feed_health",
    """with f as (select source_id, count(*) filter (where published_at is null) as failures from (select source_id, published_at, row_number() over (partition by source_id order by fetched_at desc, item_id desc) as n from raw_items) where n <= 5 group by 1)
    select source_id, failures, case when failures = 0 then 'healthy' when failures < 3 then 'degraded' else 'failed' end as health from f""",
)
def feed_health(spark, folder):
    """The state of each feed by its last five items (C2, Q27); items without date stand for failures."""
    w = Window.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("item_id"))
    last = table(spark, folder, "raw_items").select("source_id", "published_at", F.row_number().over(w).alias("n")).where("n <= 5")
    f = last.groupBy("source_id").agg(F.count_if(F.col("published_at").isNull()).alias("failures"))
    return f.withColumn("health", health(F.col("failures")))


@query("daily_quality", "select cast(fetched_at as date) as day, count(*) as items, round(count(*) filter (where title is null) / count(*), 4) as untitled, round(count(*) filter (where language_hint is null) / count(*), 4) as unlabelled from raw_items group by 1 qualify row_number() over (order by cast(fetched_at as date) desc) <= 30")
def daily_quality(spark, folder):
    """Rates of the last 30 days with items (Q27)."""
    r = lambda c, name: F.round(rate(F.col(c).isNull()), 4).alias(name)
    days = table(spark, folder, "raw_items").where("fetched_at is not null").groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("items"), r("title", "untitled"), r("language_hint", "unlabelled"))
    return days.orderBy(F.desc("day")).limit(30)


@query("meta_vocabularies", " union all ".join(f"select distinct '{c}' as attribute, cast({c} as varchar) as value from sources where {c} is not null" for c in ("country", "source_type", "source_group", "operating_base", "category", "tier", "coverage_area")))
def meta_vocabularies(spark, folder):
    """The values that each attribute of sources takes (Q25), in one pass."""
    names = ("country", "source_type", "source_group", "operating_base", "category", "tier", "coverage_area")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names]))
    return sources(spark, folder).select(pairs.alias("x")).select("x.*").where("value is not null").distinct()


@query(
    "topic_profile",
    """with n as (select primary_category as topic, source_id, count(*) as n from {items} a where primary_category is not null group by 1, 2), r as (select *, row_number() over (partition by topic order by n desc, source_id) as place from n)
    select topic, 'source' as block, cast(source_id as varchar) as key, n from r where place <= 15
    union all select primary_category, 'polarity', coalesce(sentiment, 'none'), count(*) from {items} a where primary_category is not null group by 1, 3
    union all select primary_category, 'month', strftime(day, '%Y-%m'), count(*) from {items} a where primary_category is not null group by 1, 3""",
)
def topic_profile(spark, folder):
    """Top sources, polarities and months of each topic (Q11, Q09)."""
    rows = items(spark, folder).where("primary_category is not null").withColumn("topic", F.col("primary_category"))
    count = lambda key: rows.groupBy("topic", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    by_source = rows.groupBy("topic", "source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "source_id"))).where("place <= 15")
    parts = [by_source.select("topic", F.lit("source").alias("block"), F.col("source_id").cast("string").alias("key"), "n")]
    parts += [count(key).select("topic", F.lit(name).alias("block"), "key", "n") for name, key in (("polarity", F.coalesce("sentiment", F.lit("none"))), ("month", F.date_format("day", "yyyy-MM")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "topic_corpus",
    """with l as (select max(fetched_at) as last from {items} x) select article_id from {items} a cross join l where not coalesce(is_syndicated, false) and fetched_at >= last - interval 90 day order by fetched_at desc, article_id limit 20000""",
)
def topic_corpus(spark, folder):
    """The items that a topic model is fitted on (A-T10); the limit is the sample's bound."""
    return corpus(items(spark, folder)).select("article_id")


@query(
    "prototype_scores",
    """with d as (select vec_id, label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings),
    c as (select label, i, avg(x) as m from d group by 1, 2), dots as (select d.vec_id, c.label, sum(d.x * c.m) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.m * c.m))) as s from d join c using (i) group by 1, 2)
    select vec_id as item_id, 'c' || label as category, round(4.0 * (s - 0.15) / 0.85, 4) as score from dots where s > 0.15""",
)
def prototype_scores(spark, folder):
    """Bonuses of items for the categories whose prototype, the mean of its members, is close (N4); from a bound that fits these vectors."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    means = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    p = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("prototype"))
    none = spark.createDataFrame([], f"item_id {v.schema['item_id'].dataType.simpleString()}, category string, leaf boolean, score double")
    scored = with_prototypes(none, v.select("item_id", "vector"), p.select(F.concat(F.lit("c"), "label").alias("category"), F.lit(True).alias("leaf"), "prototype"), 0.15)
    return scored.select("item_id", "category", F.round("score", 4).alias("score"))


_DENSE = """with n as (select day, {key} as key, count(*) as n from {{items}} a left join sources s using (source_id) group by 1, 2),
days as (select cast(unnest(generate_series((select min(day) from n), (select max(day) from n), interval 1 day)) as date) as day),
grid as (select day, key from days cross join (select distinct key from n)) select day, key, coalesce(n, 0) as n from grid left join n using (day, key)"""


@query("timeline_all", _DENSE.format(key="'all'"))
def timeline_all(spark, folder):
    """Items per day, zero-filled (Q02)."""
    return timeline(items(spark, folder), F.lit("all"))


@query("timeline_by_base", _DENSE.format(key="coalesce(s.operating_base, 'unknown')"))
def timeline_by_base(spark, folder):
    """Items per day and base (Q02)."""
    return timeline(items(spark, folder).join(sources(spark, folder).select("source_id", "operating_base"), "source_id", "left"), F.col("operating_base"))


@query("timeline_by_category", _DENSE.format(key=f"coalesce({PARENT_SQL}, a.primary_category, 'unknown')"))
def timeline_by_category(spark, folder):
    """Items per day and top category."""
    return timeline(items(spark, folder), F.coalesce(parent_of(F.col("primary_category")), "primary_category"))


@query("saved_annotations", "select event_type as owner, count(*) as kept, max(event_id) as newest from events where event_id % 2 = 0 group by 1")
def saved_annotations(spark, folder):
    """What each user keeps, without what was removed (Q24): appended rows and removals, the last one counts."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("owner"), "event_id")
    log = e.select("owner", "event_id", F.lit(1).alias("version"), F.lit(False).alias("removed")).unionByName(e.where("event_id % 2 <> 0").select("owner", "event_id", F.lit(2).alias("version"), F.lit(True).alias("removed")))
    last = log.groupBy("owner", "event_id").agg(F.max_by("removed", "version").alias("removed"))
    return last.where("not removed").groupBy("owner").agg(F.count(F.lit(1)).alias("kept"), F.max("event_id").alias("newest"))
