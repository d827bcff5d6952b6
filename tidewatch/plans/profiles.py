"""Profiles and comparisons of sources, groups, actors, places (Q04-Q06, Q09, Q12-Q22)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.functions.stats import rate
from tidewatch.operators.filters import ItemFilter, apply_filter, group_condition, in_subtree, status_or_demo
from tidewatch.plans.analysis import TARGETED_SQL, frame_hits, lexicon_tones, targeted_rows
from tidewatch.plans.catalog import ORACLES, items, query, sources
from tidewatch.plans.metrics import PARENT_SQL, PARENTS, parent_of
from tidewatch.tables import table


@query(
    "article_page",
    """select article_id, title, source_id, primary_category from {items} a order by fetched_at desc nulls last, article_id limit 50 offset 100""",
)
def article_page(spark, folder):
    """A page of the item list (Q04, L1)."""
    rows = items(spark, folder).select("article_id", "title", "source_id", "primary_category", "fetched_at")
    return rows.orderBy(F.desc_nulls_last("fetched_at"), "article_id").offset(100).limit(50).drop("fetched_at")


@query(
    "filtered_items",
    """select article_id, source_id from {items} a where fetched_at >= timestamp '2025-09-01' and fetched_at < timestamp '2025-12-01' and language in ('en', 'ar') and not coalesce(is_demo, false)
    and not coalesce(is_syndicated, false) and source_id in (select source_id from sources where source_type = 'newspaper' and operating_base in ('coast', 'inland'))""",
)
def filtered_items(spark, folder):
    """The standard filter."""
    from datetime import date

    f = ItemFilter(start=date(2025, 9, 1), end=date(2025, 12, 1), languages=("en", "ar"), copies=False, sources={"source_type": ("newspaper",), "operating_base": ("coast", "inland")})
    return apply_filter(items(spark, folder), sources(spark, folder), f).select("article_id", "source_id")


@query("sources_outside", "select source_id, slug from sources where source_type in ('newspaper', 'agency') and coverage_area not in ('north', 'south')")
def sources_outside(spark, folder):
    """A group with an excluded area; unknown areas drop out."""
    return sources(spark, folder).where(group_condition({"source_type": ("newspaper", "agency")}, {"coverage_area": ("north", "south")})).select("source_id", "slug")


@query(
    "article_detail",
    """with m as (select article_id, count(*) as mentions, count(distinct entity_id) as entities from entity_mentions group by 1),
    rel as (select story_cluster_id, count(*) as members from articles where story_cluster_id is not null group by 1)
    select a.article_id, s.slug, a.sentiment, coalesce(m.mentions, 0) as mentions, coalesce(m.entities, 0) as entities, coalesce(rel.members - 1, 0) as related, o.simplified as orientation
    from {items} a join sources s using (source_id) left join m using (article_id) left join rel using (story_cluster_id)
    left join (select source_id, min_by(simplified, (-epoch_us(created_at), -orientation_id)) as simplified from source_orientation where valid_to is null group by 1) o on o.source_id = a.source_id""",
)
def article_detail(spark, folder):
    """Every item with its measures, mentions, relations and the open orientation of its source (Q05)."""
    m = table(spark, folder, "entity_mentions").groupBy("article_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("entity_id").alias("entities"))
    rel = table(spark, folder, "articles").where("story_cluster_id is not null").groupBy("story_cluster_id").agg(F.count(F.lit(1)).alias("members"))
    o = table(spark, folder, "source_orientation").where("valid_to is null").groupBy("source_id").agg(F.max_by("simplified", F.struct("created_at", "orientation_id")).alias("orientation"))
    a = items(spark, folder).select("article_id", "source_id", "sentiment", "story_cluster_id").join(sources(spark, folder).select("source_id", "slug"), "source_id")
    joined = a.join(m, "article_id", "left").join(rel, "story_cluster_id", "left").join(o, "source_id", "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return joined.select("article_id", "slug", "sentiment", zero(F.col("mentions"), "mentions"), zero(F.col("entities"), "entities"), zero(F.col("members") - 1, "related"), "orientation")


@query(
    "story_members",
    """select story_cluster_id, article_id, source_id, row_number() over (partition by story_cluster_id order by fetched_at, article_id) as place from articles where story_cluster_id is not null""",
)
def story_members(spark, folder):
    """The items of each story in order of time (Q06)."""
    w = Window.partitionBy("story_cluster_id").orderBy("fetched_at", "article_id")
    return table(spark, folder, "articles").where("story_cluster_id is not null").select("story_cluster_id", "article_id", "source_id", "fetched_at").withColumn("place", F.row_number().over(w).cast("long")).drop("fetched_at")


@query(
    "source_list",
    """select s.source_id, s.slug, s.source_group, coalesce(n, 0) as articles, o.simplified from sources s left join (select source_id, count(*) as n from {items} a group by 1) a using (source_id)
    left join (select source_id, max_by(simplified, (epoch_us(created_at), orientation_id)) as simplified from source_orientation where valid_to is null group by 1) o using (source_id)""",
)
def source_list(spark, folder):
    """Sources with their items, zero included, and open orientation."""
    n = items(spark, folder).groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
    o = table(spark, folder, "source_orientation").where("valid_to is null").groupBy("source_id").agg(F.max_by("simplified", F.struct("created_at", "orientation_id")).alias("simplified"))
    return sources(spark, folder).select("source_id", "slug", "source_group").join(n, "source_id", "left").join(o, "source_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


@query(
    "source_profile_categories",
    "select source_id, coalesce(primary_category, 'none') as category, count(*) as n, round(count(*) / sum(count(*)) over (partition by source_id), 6) as share from {items} a group by 1, 2",
)
def source_profile_categories(spark, folder):
    """Categories of each source with shares (Q13)."""
    n = items(spark, folder).groupBy("source_id", F.coalesce("primary_category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source_id")), 6))


_TOP = """with n as (select {by}, {key}, count(*) as n from {from} group by 1, 2), r as (select *, row_number() over (partition by {by} order by n desc, {key}) as place from n)
select {by}, {key}, n, place from r where place <= {k}"""


def _top(n, by: str, key: str, k: int):
    w = Window.partitionBy(by).orderBy(F.desc("n"), key)
    return n.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).select(by, key, "n", "place")


@query("source_profile_actors", _TOP.format(by="source_id", key="entity_id", k=15, **{"from": "entity_mentions m join {items} a using (article_id) where entity_id is not null"}))
def source_profile_actors(spark, folder):
    """The 15 actors each source mentions most."""
    m = table(spark, folder, "entity_mentions").where("entity_id is not null").select("article_id", "entity_id")
    n = m.join(items(spark, folder).select("article_id", "source_id"), "article_id").groupBy("source_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return _top(n, "source_id", "entity_id", 15)


@query("source_profile_terms", _TOP.format(by="source_id", key="term", k=40, **{"from": "(select source_id, unnest(string_split(title, ' ')) as term from {items} a where title is not null) t where length(term) > 3"}))
def source_profile_terms(spark, folder):
    """The 40 most frequent words of each source's headlines (Q13)."""
    t = items(spark, folder).where("title is not null").select("source_id", F.explode(F.split("title", " ")).alias("term")).where("length(term) > 3")
    return _top(t.groupBy("source_id", "term").agg(F.count(F.lit(1)).alias("n")), "source_id", "term", 40)


_MOST_ACTIVE = "(select source_id from (select source_id, count(*) as n from {items} a group by 1 order by n desc, source_id limit 2))"


@query(
    "compare_sources_shared",
    f"""select story_cluster_id, count(*) as articles from {{items}} a where source_id in {_MOST_ACTIVE} and story_cluster_id is not null group by 1 having count(distinct source_id) = 2""",
)
def compare_sources_shared(spark, folder, compared: tuple[int, ...] = ()):
    """Stories that every compared source covers (Q14, G13); by default the two most active sources are compared."""
    rows = items(spark, folder)
    if not compared:
        compared = tuple(r[0] for r in rows.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(2).collect())
    a = rows.where(F.col("source_id").isin(*compared) & F.col("story_cluster_id").isNotNull())
    return a.groupBy("story_cluster_id").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source_id").alias("k")).where(F.col("k") == len(compared)).drop("k")


@query(
    "compare_groups_shared",
    """with g as (select a.story_cluster_id as story, s.operating_base as grp, a.article_id, a.title, row_number() over (partition by a.story_cluster_id, s.operating_base order by a.fetched_at desc nulls last, a.article_id) as n
      from {items} a join sources s using (source_id) where story_cluster_id is not null and s.operating_base in ('coast', 'inland')),
    both_ as (select story from g group by 1 having count(distinct grp) = 2)
    select story, grp, article_id, title from g where n = 1 and story in (select story from both_)""",
)
def compare_groups_shared(spark, folder):
    """Stories of both groups with the newest headline of each (Q15, W3, U3), without a cap on items."""
    rows = items(spark, folder).where("story_cluster_id is not null").join(sources(spark, folder).where(F.col("operating_base").isin("coast", "inland")).select("source_id", F.col("operating_base").alias("grp")), "source_id")
    newest = rows.groupBy(F.col("story_cluster_id").alias("story"), "grp").agg(F.min_by(F.struct("article_id", "title"), F.struct(F.negative(F.coalesce(F.unix_micros("fetched_at"), F.lit(-(2**62)))), "article_id")).alias("x"))
    both = newest.groupBy("story").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("story")
    return newest.join(both, "story", "left_semi").select("story", "grp", "x.article_id", "x.title")


@query(
    "actor_list",
    """select e.entity_id, e.slug, e.entity_type, coalesce(n, 0) as mentions, coalesce(a, 0) as articles from entities e
    left join (select entity_id, count(*) as n, count(distinct article_id) as a from entity_mentions group by 1) m using (entity_id)""",
)
def actor_list(spark, folder):
    """Actors with their mentions, zero included (Q16)."""
    n = table(spark, folder, "entity_mentions").groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("article_id").alias("articles"))
    e = table(spark, folder, "entities").select("entity_id", "slug", "entity_type").join(n, "entity_id", "left")
    return e.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mentions", "articles")})


@query(
    "actor_co_mentions",
    """with m as (select distinct article_id, entity_id from entity_mentions where entity_id is not null), p as (select a.entity_id, b.entity_id as other, count(*) as n from m a join m b using (article_id) where a.entity_id <> b.entity_id group by 1, 2),
    r as (select *, row_number() over (partition by entity_id order by n desc, other) as place from p) select entity_id, other, n, place from r where place <= 12""",
)
def actor_co_mentions(spark, folder):
    """The 12 actors most often named with each actor (Q17).  Pairs are made within one article only."""
    m = table(spark, folder, "entity_mentions").where("entity_id is not null").select("article_id", "entity_id").distinct()
    p = m.join(m.select("article_id", F.col("entity_id").alias("other")), "article_id").where("entity_id <> other")
    return _top(p.groupBy("entity_id", "other").agg(F.count(F.lit(1)).alias("n")), "entity_id", "other", 12)


@query(
    "terminology_by_source",
    "select m.entity_id, s.slug, al.surface_form, count(*) as n from entity_mentions m join articles a using (article_id) join sources s using (source_id) join entity_aliases al using (alias_id) group by 1, 2, 3",
)
def terminology_by_source(spark, folder):
    """Which names each source uses for an actor (Q18)."""
    m = table(spark, folder, "entity_mentions").where("alias_id is not null").select("article_id", "entity_id", "alias_id")
    al = table(spark, folder, "entity_aliases").select("alias_id", "surface_form")
    joined = m.join(table(spark, folder, "articles").select("article_id", "source_id"), "article_id").join(sources(spark, folder).select("source_id", "slug"), "source_id").join(al, "alias_id")
    return joined.groupBy("entity_id", "slug", "surface_form").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_list",
    "select event_type, cast(ts as date) as day, count(*) as events, count(distinct user_id) as users, round(sum(value), 4) as value, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k from events group by 1, 2",
)
def event_list(spark, folder):
    """Events by type and day, with a number from their JSON (Q19)."""
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k")
    )


@query(
    "geography_rollup",
    """with n as (select n_nationkey, n_name, n_regionkey, count(distinct c_custkey) as places, count(distinct o_orderkey) as items from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2, 3)
    select r_name as region, n_name as place, places, items, sum(items) over (partition by r_name)::bigint as items_of_region from n join region on r_regionkey = n_regionkey""",
)
def geography_rollup(spark, folder):
    """Items per place, zero kept, and of its region without counting anything twice."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("items"))
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    per = c.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("places"), F.sum(F.coalesce("items", F.lit(0))).alias("items"))
    n = table(spark, folder, "nation").join(per, "n_nationkey", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("places", "items")})
    joined = n.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("region"), F.col("n_name").alias("place"), "places", "items", F.sum("items").over(Window.partitionBy("r_name")).alias("items_of_region"))


@query(
    "landscape_coverage",
    """with p as (select distinct source_id, story_cluster_id as c from {items} a where story_cluster_id is not null), n as (select source_id, count(*) as n from p group by 1),
    e as (select a.source_id as source_a, b.source_id as source_b, count(*) as shared from p a join p b on a.c = b.c and a.source_id < b.source_id group by 1, 2)
    select source_a, source_b, shared, round(shared / (x.n + y.n - shared), 6) as jaccard from e join n x on x.source_id = source_a join n y on y.source_id = source_b""",
)
def landscape_coverage(spark, folder):
    """Pairs of sources that cover the same stories, with Jaccard similarity.

    Pairs are made of the distinct sources of one story; their number is bounded by the sources, not the items.
    """
    p = items(spark, folder).where("story_cluster_id is not null").select("source_id", F.col("story_cluster_id").alias("c")).distinct()
    n = p.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    e = p.select(F.col("source_id").alias("source_a"), "c").join(p.select(F.col("source_id").alias("source_b"), "c"), "c").where("source_a < source_b").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("shared"))
    e = e.join(n.select(F.col("source_id").alias("source_a"), F.col("n").alias("na")), "source_a").join(n.select(F.col("source_id").alias("source_b"), F.col("n").alias("nb")), "source_b")
    return e.select("source_a", "source_b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


_RELATIONS = """(select a.article_id as from_id, f.first as to_id, 'syndicated_from' as kind from articles a
  join (select story_cluster_id, min_by(article_id, (epoch_us(fetched_at), article_id)) as first from articles where not coalesce(is_syndicated, false) and story_cluster_id is not null group by 1) f using (story_cluster_id)
  where a.is_syndicated and a.article_id <> f.first)"""


def relations(spark, folder):
    """(from_id, to_id, kind): each copy to the first item of its story that is none."""
    a = table(spark, folder, "articles").where("story_cluster_id is not null")
    copied = F.coalesce("is_syndicated", F.lit(False))
    first = a.where(~copied).groupBy("story_cluster_id").agg(F.min_by("article_id", F.struct("fetched_at", "article_id")).alias("to_id"))
    return a.where(copied).join(first, "story_cluster_id").where("article_id <> to_id").select(F.col("article_id").alias("from_id"), "to_id", F.lit("syndicated_from").alias("kind"))


def edge_counts(rows, edges, kind: str):
    """(source_from, source_to, n): edges of a kind between items of different sources, from the items that count."""
    a = rows.select(F.col("article_id").alias("from_id"), F.col("source_id").alias("source_from"))
    b = rows.select(F.col("article_id").alias("to_id"), F.col("source_id").alias("source_to"))
    return edges.where(F.col("kind") == kind).join(a, "from_id").join(b, "to_id").where("source_from <> source_to").groupBy("source_from", "source_to").agg(F.count(F.lit(1)).alias("n"))


@query(
    "landscape_syndication",
    f"""select a.source_id as source_from, b.source_id as source_to, count(*) as n from {_RELATIONS} r join articles a on a.article_id = r.from_id join articles b on b.article_id = r.to_id
    where r.kind = 'syndicated_from' and a.source_id <> b.source_id group by 1, 2""",
)
def landscape_syndication(spark, folder):
    """Which sources copy which (Q21, J7): a walk over the items' relations."""
    return edge_counts(table(spark, folder, "articles").select("article_id", "source_id"), relations(spark, folder), "syndicated_from")


@query(
    "landscape_strong_pairs",
    """with p as (select distinct source_id, story_cluster_id as c from {items} a where story_cluster_id is not null)
    select a.source_id as source_a, b.source_id as source_b, count(*) as shared from p a join p b on a.c = b.c and a.source_id < b.source_id group by 1, 2 having count(*) >= 2""",
)
def landscape_strong_pairs(spark, folder, min_shared: int = 2):
    """Pairs of sources with at least ``min_shared`` stories in common (Q21)."""
    return landscape_coverage(spark, folder).where(F.col("shared") >= min_shared).select("source_a", "source_b", "shared")


@query(
    "narratives_share",
    """select s.operating_base as grp, coalesce(a.sentiment, 'none') as polarity, count(*) as n, round(count(*) / sum(count(*)) over (partition by s.operating_base), 6) as share
    from {items} a join sources s using (source_id) group by 1, 2""",
)
def narratives_share(spark, folder):
    """Shares of polarities by base (Q22)."""
    rows = items(spark, folder).join(sources(spark, folder).select("source_id", F.col("operating_base").alias("grp")), "source_id")
    n = rows.groupBy("grp", F.coalesce("sentiment", F.lit("none")).alias("polarity")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("grp")), 6))


_BASED = "(select a.*, s.operating_base as grp from {items} a join sources s using (source_id))"


def _based(spark, folder):
    return items(spark, folder).join(sources(spark, folder).select("source_id", F.col("operating_base").alias("grp")), "source_id")


@query("narratives_terms", _TOP.format(by="grp", key="term", k=15, **{"from": f"(select grp, unnest(string_split(lower(title), ' ')) as term from {_BASED} where title is not null) t where length(term) > 3"}))
def narratives_terms(spark, folder):
    """The 15 most frequent words of each base's headlines (Q22)."""
    t = _based(spark, folder).where("title is not null").select("grp", F.explode(F.split(F.lower("title"), " ")).alias("term")).where("length(term) > 3")
    return _top(t.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n")), "grp", "term", 15)


@query("narratives_actors", _TOP.format(by="grp", key="entity_id", k=10, **{"from": f"entity_mentions m join {_BASED} using (article_id) where entity_id is not null"}))
def narratives_actors(spark, folder):
    """The 10 actors that each base mentions most (Q22)."""
    m = table(spark, folder, "entity_mentions").where("entity_id is not null").select("article_id", "entity_id")
    return _top(m.join(_based(spark, folder).select("article_id", "grp"), "article_id").groupBy("grp", "entity_id").agg(F.count(F.lit(1)).alias("n")), "grp", "entity_id", 10)


@query(
    "narratives_tones",
    "select grp, label, count(*) as n from (" + ORACLES["lexicon_tones"] + ") t join (select a.article_id as item_id, s.operating_base as grp from articles a join sources s using (source_id)) g using (item_id) group by 1, 2",
)
def narratives_tones(spark, folder):
    """Tones by base (Q22)."""
    return lexicon_tones(spark, folder).join(_based(spark, folder).select(F.col("article_id").alias("item_id"), "grp"), "item_id").groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))


@query("narratives_frames")
def narratives_frames(spark, folder):
    """Frames by base (Q22); sentence splitting has no SQL."""
    return frame_hits(spark, folder).join(_based(spark, folder).select(F.col("article_id").alias("item_id"), "grp"), "item_id").groupBy("grp", "frame").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_profile_days",
    """select source_id, count(*) as articles, count(distinct day) as days, min(day) as first_day, max(day) as last_day, round(avg(word_count), 4) as mean_words, round(count(*) filter (where is_syndicated) / count(*), 4) as copy_rate,
    round(count(*) filter (where author is not null and author <> '') / count(*), 4) as signed_rate from {items} a group by 1""",
)
def source_profile_days(spark, folder):
    """Activity of each source: items, days, lengths, copies, signed items (Q13)."""
    r = lambda c, name: F.round(rate(F.coalesce(c, F.lit(False))), 4).alias(name)
    return items(spark, folder).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.round(F.avg("word_count"), 4).alias("mean_words"), r(F.col("is_syndicated"), "copy_rate"), r(F.col("author") != "", "signed_rate"),
    )


@query("source_profile_sentiment", "select source_id, coalesce(sentiment, 'none') as polarity, count(*) as n, round(count(*) / sum(count(*)) over (partition by source_id), 6) as share from {items} a group by 1, 2")
def source_profile_sentiment(spark, folder):
    """Polarities of each source with shares (Q13)."""
    n = items(spark, folder).groupBy("source_id", F.coalesce("sentiment", F.lit("none")).alias("polarity")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source_id")), 6))


@query("source_profile_languages", "select source_id, coalesce(language, 'unknown') as language, count(*) as n from {items} a group by 1, 2")
def source_profile_languages(spark, folder):
    """Languages of each source (Q13)."""
    return items(spark, folder).groupBy("source_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_profile_targets",
    f"""select a.source_id, t.entity_id, count(*) as n, round(avg(t.score), 4) as mean_score from {TARGETED_SQL} t join {{items}} a on a.article_id = t.item_id group by 1, 2""",
)
def source_profile_targets(spark, folder):
    """What each source says about actors (Q13)."""
    rows = items(spark, folder).select(F.col("article_id").alias("item_id"), "source_id")
    return targeted_rows(spark, folder).join(rows, "item_id").groupBy("source_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(
    "category_tree",
    f"""with c as (select primary_category as category, {PARENT_SQL} as parent, count(*) as n from {{items}} a where primary_category is not null group by 1, 2),
    p as (select parent as category, sum(n)::bigint as rolled from c where parent is not null group by 1),
    roots as (select category, n as direct from c where parent is null union all select category, 0 from p where category not in (select category from c where parent is null)),
    kids as (select parent as category, string_agg(category || ' ' || n, ', ' order by n desc, category) as children from c where parent is not null group by 1)
    select category, greatest(max(direct), coalesce(max(rolled), 0)) as items, coalesce(max(children), '') as children from roots left join p using (category) left join kids using (category) group by 1""",
)
def category_tree(spark, folder):
    """Top categories with their children by number of items (Q08, L4)."""
    c = items(spark, folder).where("primary_category is not null").groupBy(F.col("primary_category").alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("parent", parent_of(F.col("category")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.negative("n").alias("o"), "category", "n"))), lambda x: F.concat(x["category"], F.lit(" "), x["n"].cast("string")))
    p = c.where("parent is not null").groupBy(F.col("parent").alias("category")).agg(F.sum("n").alias("rolled"), F.array_join(listed, ", ").alias("children"))
    direct = c.where("parent is null").select("category", F.col("n").alias("direct"))
    return direct.join(p, "category", "full").select("category", F.greatest(F.coalesce("direct", F.lit(0)), F.coalesce("rolled", F.lit(0))).alias("items"), F.coalesce("children", F.lit("")).alias("children"))


@query(
    "category_subtree_items",
    f"select article_id, primary_category from {{items}} a where primary_category = 'society' or {PARENT_SQL} = 'society'",
)
def category_subtree_items(spark, folder):
    """The items of a category and of all below it."""
    tree = spark.createDataFrame(list(PARENTS.items()), "category string, parent string")
    return in_subtree(items(spark, folder), tree, "society").select("article_id", "primary_category")


@query("registry_or_demo", "select source_id, slug from sources where tier = 'A' or coalesce(is_demo, false)")
def registry_or_demo(spark, folder):
    """Sources of a registry status, and demonstration sources whatever their status (F8)."""
    return sources(spark, folder).where(status_or_demo("tier", "A")).select("source_id", "slug")


@query(
    "article_total",
    "select count(*) as total, least(count(*) - 100, 50) as on_page from {items} a",
)
def article_total(spark, folder):
    """How many items the list has in all, and how many stand on the page of ``article_page`` (L1)."""
    return items(spark, folder).agg(F.count(F.lit(1)).alias("total")).withColumn("on_page", F.least(F.col("total") - 100, F.lit(50)))


@query(
    "article_document",
    """with m as (select article_id, list_sort(list(entity_id || ':' || surface_form)) as mentions from entity_mentions where entity_id is not null group by 1),
    st as (select article_id as this, story_cluster_id from {items} a where story_cluster_id is not null),
    r as (select st.this as article_id, list_sort(list(b.article_id)) as related from st join {items} b on b.story_cluster_id = st.story_cluster_id and b.article_id <> st.this group by 1)
    select a.article_id, a.title, s.slug as source, a.language, a.sentiment, coalesce(array_to_string(m.mentions, '; '), '') as mentions, coalesce(array_to_string(r.related, ', '), '') as related
    from {items} a join sources s using (source_id) left join m using (article_id) left join r using (article_id)""",
)
def article_document(spark, folder):
    """Every item with its source, its mentions and the other items of its story as nested lists (Q05)."""
    rows = items(spark, folder)
    m = table(spark, folder, "entity_mentions").where("entity_id is not null").groupBy("article_id").agg(F.sort_array(F.collect_list(F.concat("entity_id", F.lit(":"), "surface_form"))).alias("mentions"))
    st = rows.where("story_cluster_id is not null").select("article_id", "story_cluster_id")
    other = st.select(F.col("article_id").alias("other"), "story_cluster_id")
    r = st.join(other, "story_cluster_id").where("article_id <> other").groupBy("article_id").agg(F.sort_array(F.collect_list("other")).alias("related"))
    whole = rows.join(sources(spark, folder).select("source_id", F.col("slug").alias("source")), "source_id").join(m, "article_id", "left").join(r, "article_id", "left")
    text = lambda c, by: F.coalesce(F.array_join(c, by), F.lit("")).alias(c)
    return whole.select("article_id", "title", "source", "language", "sentiment", text("mentions", "; "), text("related", ", "))


@query(
    "category_profile",
    """select primary_category as category, s.operating_base as base, count(*) as n, count(distinct a.source_id) as sources, count(*) filter (where sentiment = 'negative') as negative
    from {items} a join sources s using (source_id) where primary_category is not null group by 1, 2""",
)
def category_profile(spark, folder):
    """Categories by base (Q09)."""
    rows = items(spark, folder).where("primary_category is not null").join(sources(spark, folder).select("source_id", F.col("operating_base").alias("base")), "source_id")
    return rows.groupBy(F.col("primary_category").alias("category"), "base").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.count_if(F.col("sentiment") == "negative").alias("negative"))


@query(
    "percentile_by_label",
    "select event_type, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as median, min(value) as least, max(value) as most from events group by 1",
)
def percentile_by_label(spark, folder):
    """Interpolated percentiles."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.1), 6).alias("p10"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("never_mentioned", "select entity_id, slug from entities where entity_id not in (select entity_id from entity_mentions where entity_id is not null)")
def never_mentioned(spark, folder):
    """Actors without any mention."""
    return table(spark, folder, "entities").select("entity_id", "slug").join(table(spark, folder, "entity_mentions").where("entity_id is not null").select("entity_id"), "entity_id", "left_anti")


@query("affected_days", "with last as (select max(fetched_at)::date as last, max(batch_no) as b from articles) select distinct day from (select cast(unnest(generate_series(last - 13, last, interval 1 day)) as date) as day from last union select cast(fetched_at as date) from articles where batch_no = (select b from last)) x")
def affected_days(spark, folder, batch: int | None = None):
    """Days to compute again: the last 14 and those that a batch touched, the last one by default (D3)."""
    a = table(spark, folder, "articles")
    recent = a.agg(F.to_date(F.max("fetched_at")).alias("last")).select(F.explode(F.sequence(F.date_sub("last", 13), F.col("last"))).alias("day"))
    touched = a.where(F.col("batch_no") == batch) if batch is not None else a.join(F.broadcast(a.agg(F.max("batch_no").alias("batch_no"))), "batch_no")
    return recent.union(touched.select(F.to_date("fetched_at").alias("day"))).distinct()
