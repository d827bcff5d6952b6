"""Near duplicates, semantic links, daily summaries (A-D2, A-D3, Q03, T18)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.functions.text import matching_form
from tidewatch.operators.similar import near_duplicates, semantic_links
from tidewatch.plans.catalog import items, query, sources
from tidewatch.tables import table


@query("near_duplicates")
def near_duplicate_items(spark, folder):
    """What each delivered item repeats of the two days before (A-D2); tested against a plain version."""
    r = table(spark, folder, "articles")
    return near_duplicates(r.select(F.col("article_id").alias("item_id"), "source_id", F.col("fetched_at").alias("at"), "language", matching_form(F.col("title")).alias("title"), matching_form(F.col("excerpt")).alias("text")))


@query(
    "semantic_links",
    """with v as (select vec_id, label, embedding::double[] as e, epoch_us(timestamp '2025-01-01') // 1000000 + vec_id * 3600 as s from embeddings),
    m as (select a.vec_id as item_id, b.vec_id as other_id, a.label <> b.label as apart, list_cosine_similarity(a.e, b.e) as sim from v a join v b on (b.s < a.s or (b.s = a.s and b.vec_id < a.vec_id)) and a.s - b.s <= 345600),
    r as (select *, row_number() over (partition by item_id order by sim desc, other_id) as n from m where sim >= 0.15)
    select item_id, other_id, case when sim >= 0.2 and apart then 'same_story' else 'similar' end as kind, round(sim, 5) as similarity from r where n <= 10""",
)
def semantic_link_vectors(spark, folder):
    """Links between vectors one hour apart each; labels stand for sources, thresholds fit these vectors (A-D3)."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("source_id"), F.timestamp_seconds(F.unix_timestamp(F.lit("2025-01-01").cast("timestamp")) + F.col("vec_id") * 3600).alias("at"), F.col("embedding").alias("vector"))
    return semantic_links(v, 0.2, 0.15).withColumn("similarity", F.round("similarity", 5))


@query(
    "daily_summaries",
    """with c as (select day, primary_category as k, count(*) as n from {items} a where primary_category is not null group by 1, 2), r as (select *, row_number() over (partition by day order by n desc, k) as p from c),
    t as (select day, string_agg(k || ' (' || n || ')', ', ' order by p) as top from r where p <= 3 group by 1),
    b as (select day, coalesce(s.operating_base, 'unknown') as k, count(*) as n from {items} a left join sources s using (source_id) group by 1, 2), bb as (select day, string_agg(k || ' ' || n, ', ' order by n desc, k) as bases from b group by 1),
    d as (select day, count(*) as n, count(distinct source_id) as s from {items} a group by 1)
    select day, n || ' articles from ' || s || ' sources. Top categories: ' || coalesce(top, 'none') || '. By base: ' || bases || '.' as summary from d left join t using (day) join bb using (day)""",
)
def daily_summaries(spark, folder):
    """One sentence of counts per day, from templates."""
    rows = items(spark, folder).join(sources(spark, folder).select("source_id", F.coalesce("operating_base", F.lit("unknown")).alias("base")), "source_id", "left").withColumn("base", F.coalesce("base", F.lit("unknown")))
    c = rows.where("primary_category is not null").groupBy("day", F.col("primary_category").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    listed = lambda df, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.negative("n").alias("o"), "k", "n"))), lambda x: F.concat(x["k"], F.lit(text[0]), x["n"].cast("string"), F.lit(text[1]))), ", ")
    w = Window.partitionBy("day").orderBy(F.desc("n"), "k")
    top = c.withColumn("p", F.row_number().over(w)).where("p <= 3").groupBy("day").agg(listed(c, (" (", ")")).alias("top"))
    b = rows.groupBy("day", F.col("base").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(listed(rows, (" ", "")).alias("bases"))
    d = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("s"))
    text = F.concat(F.col("n").cast("string"), F.lit(" articles from "), F.col("s").cast("string"), F.lit(" sources. Top categories: "), F.coalesce("top", F.lit("none")), F.lit(". By base: "), "bases", F.lit("."))
    return d.join(top, "day", "left").join(b, "day").select("day", text.alias("summary"))
