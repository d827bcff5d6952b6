"""Aggregates per day, source, category and entity (M01-M07), overviews and trends (Q01-Q03, Q10, Q27)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.functions.stats import distribution, entropy, rate, signed_sentiment
from tidewatch.operators.series import dense_days, drift, trends
from tidewatch.plans.analysis import TARGETED_SQL, targeted_rows
from tidewatch.plans.catalog import items, query, sources
from tidewatch.tables import table

def _story():
    return F.coalesce(F.col("story_cluster_id").cast("long"), -F.col("article_id"))


STORY_SQL = "coalesce(cast(story_cluster_id as bigint), -article_id)"
SENTIMENT_SQL = "case sentiment when 'positive' then 1.0 when 'negative' then -1.0 when 'neutral' then 0.0 when 'mixed' then 0.0 end"
_TIMELINE = """with n as (select day, coalesce({key}, 'unknown') as key, count(*) as n from {items} a {join} group by 1, 2),
days as (select cast(unnest(generate_series((select min(day) from n), (select max(day) from n), interval 1 day)) as date) as day),
grid as (select day, key from days cross join (select distinct key from n))
select day, key, coalesce(n, 0) as n from grid left join n using (day, key)"""


def timeline(rows, key):
    """Items per day and key, zero-filled."""
    n = rows.groupBy("day", F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return dense_days(n, "key")


@query("timeline_by_group", _TIMELINE.replace("{key}", "source_group").replace("{join}", "left join sources s using (source_id)"))
def timeline_by_group(spark, folder):
    return timeline(items(spark, folder).join(sources(spark, folder).select("source_id", "source_group"), "source_id", "left"), F.col("source_group"))


@query("timeline_by_language", _TIMELINE.replace("{key}", "language").replace("{join}", ""))
def timeline_by_language(spark, folder):
    return timeline(items(spark, folder), F.col("language"))


@query("timeline_by_sentiment", _TIMELINE.replace("{key}", "sentiment").replace("{join}", ""))
def timeline_by_sentiment(spark, folder):
    return timeline(items(spark, folder), F.col("sentiment"))


@query(
    "overview_kpis",
    f"""with last as (select max(day) as last from {{items}} x), p as (select *, case when day > last - 30 then 'current' else 'previous' end as period
    from {{items}} a cross join last where day > last - 60)
    select period, count(*) as articles, count(distinct {STORY_SQL}) as stories, count(distinct source_id) as active_sources,
    count(distinct language) as languages, count(*) filter (where is_demo) as demo from p group by 1""",
)
def overview_kpis(spark, folder):
    rows = items(spark, folder)
    last = rows.agg(F.max("day").alias("last"))
    p = rows.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("last", 60)).withColumn("period", F.when(F.col("day") > F.date_sub("last", 30), "current").otherwise("previous"))
    return p.groupBy("period").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct(_story()).alias("stories"), F.countDistinct("source_id").alias("active_sources"), F.countDistinct("language").alias("languages"), F.count_if("is_demo").alias("demo")
    )


@query(
    "daily_metrics",
    f"""with d as (select day, count(*) as articles, count(distinct {STORY_SQL}) as stories, count(distinct source_id) as sources,
    count(distinct coalesce(language, 'unknown')) as languages, round(count(*) filter (where is_syndicated) / count(*), 6) as copy_rate, count(*) filter (where sentiment = 'negative') as negative
    from {{items}} a group by 1),
    w as (select cast(fetched_at as date) as day, count(*) as n from articles group by 1),
    c as (select day, primary_category as k, cast(count(*) as double) as n from {{items}} a where primary_category is not null group by 1, 2),
    e as (select day, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) as category_entropy from c group by 1)
    select d.*, round(1 - articles / w.n, 4) as left_out_rate, category_entropy from d join w using (day) left join e using (day)""",
)
def daily_metrics(spark, folder):
    """Items of each day; ``left_out_rate`` is the share of all delivered that don't count."""
    rows = items(spark, folder)
    d = rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct(_story()).alias("stories"), F.countDistinct("source_id").alias("sources"), F.countDistinct(F.coalesce("language", F.lit("unknown"))).alias("languages"),
        F.round(rate(F.coalesce("is_syndicated", F.lit(False))), 6).alias("copy_rate"), F.count_if(F.col("sentiment") == "negative").alias("negative"),
    )
    w = table(spark, folder, "articles").groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    e = entropy(rows.where("primary_category is not null"), ["day"], "primary_category").select("day", F.round("entropy", 6).alias("category_entropy"))
    return d.join(w, "day").withColumn("left_out_rate", F.round(1 - F.col("articles") / F.col("n"), 4)).drop("n").join(e, "day", "left")


_DISTRIBUTIONS = {"language": "language", "sentiment": "sentiment", "category": "primary_category"}


@query(
    "daily_distributions",
    " union all ".join(f"select day, '{name}' as dimension, coalesce({column}, 'unknown') as key, count(*) as n from {{items}} a group by 1, 3" for name, column in _DISTRIBUTIONS.items()),
)
def daily_distributions(spark, folder):
    """The distributions of a day over languages, sentiments and categories (M01), in one pass."""
    parts = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), F.coalesce(column, F.lit("unknown")).alias("key")) for name, column in _DISTRIBUTIONS.items()]))
    return items(spark, folder).select("day", parts.alias("x")).groupBy("day", "x.dimension", "x.key").agg(F.count(F.lit(1)).alias("n"))


@query("source_distributions", "select source_id, day, coalesce(primary_category, 'unknown') as category, count(*) as n from {items} a group by 1, 2, 3")
def source_distributions(spark, folder):
    """The categories of each source per day."""
    return items(spark, folder).groupBy("source_id", "day", F.coalesce("primary_category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("daily_language_map")
def daily_language_map(spark, folder):
    """Day to map of language counts; maps have no common hash in SQL, tests compare them."""
    return distribution(items(spark, folder).where("language is not null"), ["day"], "language", "languages")


# The categories' parents in this data, which has none of its own.
PARENTS = {"trade": "economy", "transport": "economy", "services": "society", "health": "society", "education": "society"}
PARENT_SQL = "case primary_category " + " ".join(f"when '{c}' then '{p}'" for c, p in PARENTS.items()) + " end"


def parent_of(category):
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PARENTS.items() for x in pair]), category)


@query(
    "topic_metrics",
    f"""with x as (select article_id, primary_category as category from {{items}} a where primary_category is not null union select article_id, {PARENT_SQL} from {{items}} a where {PARENT_SQL} is not null)
    select category, day, count(*) as articles, count(distinct {STORY_SQL}) as stories, count(distinct source_id) as sources,
    count(distinct language) as languages, round(avg({SENTIMENT_SQL}), 6) as mean_sentiment from x join {{items}} a using (article_id) group by 1, 2""",
)
def topic_metrics(spark, folder):
    """Items per category and day, those of children in their parent as well, once each."""
    rows = items(spark, folder).withColumn("category", F.explode(F.array_distinct(F.array_compact(F.array("primary_category", parent_of(F.col("primary_category")))))))
    return rows.groupBy("category", "day").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct(_story()).alias("stories"), F.countDistinct("source_id").alias("sources"), F.countDistinct("language").alias("languages"),
        F.round(F.avg(signed_sentiment(F.col("sentiment"))), 6).alias("mean_sentiment"),
    )


@query(
    "source_metrics",
    f"""select s.slug, s.source_group, day, count(*) as articles, count(distinct primary_category) as categories, round(avg({SENTIMENT_SQL}), 6) as mean_sentiment,
    sum(coalesce(word_count, 0))::bigint as words from {{items}} a join sources s using (source_id) group by 1, 2, 3""",
)
def source_metrics(spark, folder):
    rows = items(spark, folder).join(sources(spark, folder).select("source_id", "slug", "source_group"), "source_id")
    return rows.groupBy("slug", "source_group", "day").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("primary_category").alias("categories"), F.round(F.avg(signed_sentiment(F.col("sentiment"))), 6).alias("mean_sentiment"),
        F.sum(F.coalesce("word_count", F.lit(0))).cast("long").alias("words"),
    )


@query(
    "entity_metrics",
    f"""with t as (select t.entity_id, a.day, round(avg(t.score), 4) as s from {TARGETED_SQL} t join {{items}} a on a.article_id = t.item_id group by 1, 2),
    n as (select m.entity_id, a.day, count(*) as mentions, count(distinct a.article_id) as articles, count(distinct a.source_id) as sources from entity_mentions m join {{items}} a using (article_id) where m.entity_id is not null group by 1, 2)
    select n.*, t.s as mean_targeted_sentiment from n left join t using (entity_id, day)""",
)
def entity_metrics(spark, folder):
    """Mentions of each actor per day, and the mean of what is said about them, each sentence once."""
    rows = items(spark, folder).select("article_id", "day", "source_id")
    m = table(spark, folder, "entity_mentions").where("entity_id is not null").select("article_id", "entity_id")
    n = m.join(rows, "article_id").groupBy("entity_id", "day").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("article_id").alias("articles"), F.countDistinct("source_id").alias("sources"))
    t = targeted_rows(spark, folder).join(rows.select(F.col("article_id").alias("item_id"), "day"), "item_id").groupBy("entity_id", "day").agg(F.round(F.avg("score"), 4).alias("mean_targeted_sentiment"))
    return n.join(t, ["entity_id", "day"], "left")


@query(
    "terminology_variants",
    """select m.alias_id, a.source_id, m.entity_id, a.day, count(*) as n from entity_mentions m join {items} a using (article_id)
    where m.alias_id is not null group by 1, 2, 3, 4""",
)
def terminology_variants(spark, folder):
    m = table(spark, folder, "entity_mentions").where("alias_id is not null").select("article_id", "alias_id", "entity_id")
    return m.join(items(spark, folder).select("article_id", "source_id", "day"), "article_id").groupBy("alias_id", "source_id", "entity_id", "day").agg(F.count(F.lit(1)).alias("n"))


_ASSIGNED = "(select distinct l_orderkey as item, s_nationkey as child, n_regionkey as parent from lineitem join supplier on l_suppkey = s_suppkey join nation on n_nationkey = s_nationkey)"


def _assigned(spark, folder):
    """Items to leaf categories and their parents: order lines by the nation and region of their supplier."""
    s = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("s_suppkey")).join(s, "s_suppkey").select("item", "child", "parent").distinct()


@query(
    "category_rollup_union",
    f"""with a as {_ASSIGNED}, u as (select item, 'c' || child as category from a union select item, 'p' || parent as category from a)
    select category, count(*) as items from u group by 1""",
)
def category_rollup_union(spark, folder):
    """Each category with its own and its children's items, once each."""
    a = _assigned(spark, folder)
    u = a.select("item", F.concat(F.lit("c"), "child").alias("category")).union(a.select("item", F.concat(F.lit("p"), "parent").alias("category"))).distinct()
    return u.groupBy("category").agg(F.count(F.lit(1)).alias("items"))


@query(
    "category_rollup_max",
    f"""with a as {_ASSIGNED}, own as (select distinct o_orderkey as item, n_regionkey as category from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
    direct as (select 'c' || child as category, count(*) as n from a group by 1 union all select 'p' || category, count(*) from own group by 1),
    rolled as (select 'p' || parent as category, count(distinct item) as n from a group by 1)
    select category, greatest(coalesce(d.n, 0), coalesce(r.n, 0)) as items from direct d full join rolled r using (category)""",
)
def category_rollup_max(spark, folder):
    """The larger of a category's direct items and those of all its children, each item once.

    Order lines belong to the nation of their supplier, and orders to the region of their customer.
    """
    a = _assigned(spark, folder)
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("parent"))
    own = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey")
    count = lambda rows, mark, key, what: rows.groupBy(F.concat(F.lit(mark), key).alias("category")).agg(F.countDistinct(what).alias("n"))
    direct = count(a, "c", "child", "item").unionByName(count(own, "p", "parent", "o_orderkey")).withColumnRenamed("n", "d")
    return direct.join(count(a, "p", "parent", "item").withColumnRenamed("n", "r"), "category", "full").select("category", F.greatest(F.coalesce("d", F.lit(0)), F.coalesce("r", F.lit(0))).alias("items"))


_TRENDS = """with last as (select max(day) as last from {items} x), a as (select primary_category as category, source_id, language, date_diff('day', day, last) as age
  from {items} i cross join last where primary_category is not null and date_diff('day', day, last) < 14),
daily as (select category, age, count(*) as n, count(distinct language) as langs from a group by 1, 2),
sums as (select category, coalesce(sum(n) filter (where age < 7), 0)::bigint as recent, coalesce(sum(n) filter (where age >= 7), 0)::bigint as previous,
  coalesce(sum(n) filter (where age < 4), 0)::bigint as second_half, coalesce(sum(n) filter (where age between 4 and 6), 0)::bigint as first_half,
  coalesce(max(langs) filter (where age < 7), 0)::bigint as max_daily_languages from daily group by 1),
bs as (select category, source_id, cast(count(*) as double) as n from a where age < 7 group by 1, 2),
sp as (select category, count(*) as sources, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from bs group by 1),
g as (select *, (recent - previous) / (previous + 1) as gr, (second_half - first_half) / (first_half + 1) as ac, coalesce(sources, 0) as so from sums left join sp using (category))
select category, recent, previous, round(gr, 4) as growth, round(ac, 4) as acceleration, so as sources, round(coalesce(h, 0), 4) as source_entropy, max_daily_languages,
  case when gr >= 1 and recent >= 5 and so >= 3 then 'emerging' when gr <= -0.5 and previous >= 5 then 'declining' else 'stable' end as status from g"""


@query("trends_7d", _TRENDS)
def trends_7d(spark, folder):
    rows = items(spark, folder).select("day", F.col("primary_category").alias("category"), "source_id", "language")
    # The last day is that of all items, with or without category.
    return trends(rows, "category")


_DRIFT = """with last as (select max(day) as last from {items} x), w as (select k, date_diff('day', day, last) as age from (KEYS) q cross join last),
n as (select k, cast(count(*) filter (where age < 7) as double) as a, cast(count(*) filter (where age >= 7) as double) as b from w where age < 14 and k is not null group by 1),
p as (select a / sum(a) over () as p, b / sum(b) over () as q from n),
v as (select (sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / 2 as v from p)
select 'NAME' as metric, round(v, 5) as divergence, coalesce(v > LIMIT, false) as drifted from v"""


@query(
    "drift_reports",
    " union all ".join(
        "(" + _DRIFT.replace("KEYS", keys).replace("NAME", name).replace("LIMIT", limit) + ")"
        for name, keys, limit in (("language", "select day, language as k from {items} a", "0.10"), ("group", "select day, source_group as k from {items} a join sources using (source_id)", "0.15"), ("sentiment", "select day, sentiment as k from {items} a", "0.10"))
    ),
)
def drift_reports(spark, folder):
    rows = items(spark, folder).join(sources(spark, folder).select("source_id", "source_group"), "source_id")
    parts = [drift(rows, "language", F.col("language"), 0.10), drift(rows, "group", F.col("source_group"), 0.15), drift(rows, "sentiment", F.col("sentiment"), 0.10)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "drift_vocabulary",
    """with last as (select max(day) as last from {items} x), w as (select unnest(string_split(lower(title), ' ')) as k, date_diff('day', day, last) as age
      from {items} i cross join last where title is not null and date_diff('day', day, last) < 14),
    n as (select k, cast(count(*) filter (where age < 7) as double) as a, cast(count(*) filter (where age >= 7) as double) as b, count(*) as c from w where length(k) > 3 group by 1 order by c desc, k limit 500),
    p as (select a / sum(a) over () as p, b / sum(b) over () as q from n)
    select round((sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / 2, 5) as divergence from p""",
)
def drift_vocabulary(spark, folder):
    """Divergence of the 500 most frequent words of headlines between the last two weeks."""
    rows = items(spark, folder)
    last = rows.agg(F.max("day").alias("last"))
    aged = rows.where("title is not null").crossJoin(F.broadcast(last)).select(F.explode(F.split(F.lower("title"), " ")).alias("k"), F.datediff("last", "day").alias("age")).where("age < 14 and length(k) > 3")
    n = aged.groupBy("k").agg(F.count_if(F.col("age") < 7).cast("double").alias("a"), F.count_if(F.col("age") >= 7).cast("double").alias("b"), F.count(F.lit(1)).alias("c"))
    top = n.orderBy(F.desc("c"), "k").limit(500)
    whole = top.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p = top.crossJoin(F.broadcast(whole)).select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    return p.agg(F.round((F.sum(kl("p")) + F.sum(kl("q"))) / 2, 5).alias("divergence"))


@query(
    "quality_rates",
    """select s.source_group, count(*) as articles, round(count(*) filter (where a.author is null) / count(*), 4) as no_author, round(count(*) filter (where a.is_mixed_language) / count(*), 4) as mixed,
    round(count(*) filter (where a.processing_status = 'error') / count(*), 4) as failed, round(count(*) filter (where a.title is null or a.excerpt is null) / count(*), 4) as incomplete
    from articles a join sources s using (source_id) group by 1""",
)
def quality_rates(spark, folder):
    rows = table(spark, folder, "articles").join(sources(spark, folder).select("source_id", "source_group"), "source_id")
    r = lambda c: F.round(rate(F.coalesce(c, F.lit(False))), 4)
    return rows.groupBy("source_group").agg(
        F.count(F.lit(1)).alias("articles"), r(F.col("author").isNull()).alias("no_author"), r(F.col("is_mixed_language")).alias("mixed"), r(F.col("processing_status") == "error").alias("failed"),
        r(F.col("title").isNull() | F.col("excerpt").isNull()).alias("incomplete"),
    )


@query(
    "silent_sources",
    """with last as (select max(fetched_at) as last from articles), s as (select s.source_id, s.slug, max(a.fetched_at) as seen from sources s left join articles a using (source_id) group by 1, 2)
    select source_id, slug, cast(seen as date) as last_day from s cross join last where seen is null or seen < last - interval 7 day""",
)
def silent_sources(spark, folder):
    """Sources without an item in the last seven days."""
    rows = table(spark, folder, "articles")
    last = rows.agg(F.max("fetched_at").alias("last"))
    seen = rows.groupBy("source_id").agg(F.max("fetched_at").alias("seen"))
    s = sources(spark, folder).select("source_id", "slug").join(seen, "source_id", "left").crossJoin(F.broadcast(last))
    return s.where(F.col("seen").isNull() | (F.col("seen") < F.col("last") - F.expr("interval 7 days"))).orderBy(F.asc_nulls_first("seen")).select("source_id", "slug", F.to_date("seen").alias("last_day"))


@query(
    "latest_per_source",
    """select source_id, article_id, language from (select *, row_number() over (partition by source_id order by fetched_at desc nulls last, article_id) as n from articles) where n = 1""",
)
def latest_per_source(spark, folder):
    w = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("fetched_at"), "article_id")
    return table(spark, folder, "articles").select("source_id", "article_id", "language", "fetched_at").withColumn("n", F.row_number().over(w)).where("n = 1").select("source_id", "article_id", "language")


@query(
    "live_report_languages",
    """select s.category, count(distinct a.source_id) as sources, count(*) as articles, array_to_string(list_sort(list(distinct a.language) filter (where a.language <> '')), ', ') as languages
    from articles a join sources s using (source_id) group by 1""",
)
def live_report_languages(spark, folder):
    """Languages seen per source category."""
    rows = table(spark, folder, "articles").join(sources(spark, folder).select("source_id", "category"), "source_id")
    listed = F.array_join(F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))), ", ")
    return rows.groupBy("category").agg(F.countDistinct("source_id").alias("sources"), F.count(F.lit(1)).alias("articles"), listed.alias("languages"))


@query(
    "stories_by_sources",
    """with c as (select story_cluster_id, count(distinct source_id) as sources, count(*) as articles from articles where story_cluster_id is not null group by 1)
    select sources, count(*) as stories, sum(articles)::bigint as articles from c group by 1""",
)
def stories_by_sources(spark, folder):
    """How many stories are carried by how many sources."""
    c = table(spark, folder, "articles").where("story_cluster_id is not null").groupBy("story_cluster_id").agg(F.countDistinct("source_id").alias("sources"), F.count(F.lit(1)).alias("articles"))
    return c.groupBy("sources").agg(F.count(F.lit(1)).alias("stories"), F.sum("articles").alias("articles"))


@query("data_range", "select min(fetched_at)::date as first_day, max(fetched_at)::date as last_day, count(*) as items from articles")
def data_range(spark, folder):
    return table(spark, folder, "articles").agg(F.to_date(F.min("fetched_at")).alias("first_day"), F.to_date(F.max("fetched_at")).alias("last_day"), F.count(F.lit(1)).alias("items"))
