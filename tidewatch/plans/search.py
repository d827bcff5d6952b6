"""Search, vectors, topics and stories (Q07, Q11, A-D1, A-D4, A-T5, A-T6)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.functions.text import content_hash
from tidewatch.operators.graphs import components, exact_duplicates, story_statistics
from tidewatch.operators.search import assign, centroids, fuse, keyword_search, matches, nearest
from tidewatch.operators.topics import class_tfidf, coherence, document_terms, kmeans_topics
from tidewatch.plans.catalog import items, query
from tidewatch.tables import table


def _texts(spark, folder):
    return items(spark, folder).select(F.col("article_id").alias("item_id"), "title", F.col("excerpt").alias("text"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(
    "keyword_filter",
    r"""with t as (select article_id, ' ' || array_to_string(regexp_extract_all(lower(concat_ws(' ', title, excerpt)), '[\p{L}\p{N}]+'), ' ') || ' ' as w from {items} a)
    select article_id as item_id from t where (contains(w, ' bridge tolls ') and not contains(w, ' council ')) or contains(w, ' diesel ')""",
)
def keyword_filter(spark, folder):
    """Items that match a query with a phrase, a negation and an alternative."""
    return _texts(spark, folder).where(matches(F.concat_ws(" ", "title", "text"), '"bridge tolls" -council or diesel')).select("item_id")


@query("substring_filter", "select article_id as item_id from {items} a where contains(lower(concat_ws(' ', title, excerpt)), 'ferry tick') order by 1 limit 200")
def substring_filter(spark, folder):
    """The fallback: no whole word matches, so items that hold the query (F13); ordered by id."""
    return keyword_search(_texts(spark, folder), "ferry tick").select("item_id")


@query(
    "vector_topk",
    """with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0), s as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s from embeddings e join q on e.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by s desc, id) as place from s) select query_id, id, round(s, 5) as similarity, place from r where place <= 10""",
)
def vector_topk(spark, folder):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    v = _vectors(spark, folder)
    found = nearest(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), v, 10)
    return found.select("query_id", "id", F.round("similarity", 5).alias("similarity"), F.col("place").cast("long").alias("place"))


@query(
    "centroid_assign",
    """with d as (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings), m as (select label, dim, avg(x) as x from d group by 1, 2), c as (select label, list(x order by dim) as c from m group by 1),
    s as (select e.vec_id as id, c.label, list_cosine_similarity(e.embedding::double[], c.c) as s from embeddings e cross join c), r as (select *, row_number() over (partition by id order by s desc, label) as n from s)
    select id, label, round(s, 5) as similarity from r where n = 1""",
)
def centroid_assign(spark, folder):
    """Every vector to its nearest centroid."""
    v = _vectors(spark, folder)
    return assign(v, centroids(v, "label"), "label").select("id", "label", F.round("similarity", 5).alias("similarity"))


@query(
    "hybrid_search",
    r"""with t as (select article_id as item_id, lower(coalesce(title, '')) as ti, lower(coalesce(excerpt, '')) as tx, length(coalesce(excerpt, '')) as n from {items} a),
    k as (select item_id, (len(regexp_extract_all(' ' || ti || ' ', '[^\p{L}\p{N}]diesel[^\p{L}\p{N}]')) + 0.4 * len(regexp_extract_all(' ' || tx || ' ', '[^\p{L}\p{N}]diesel[^\p{L}\p{N}]'))) / (1 + ln(1 + n)) as r from t where regexp_matches(' ' || ti || ' ' || tx || ' ', '[^\p{L}\p{N}]diesel[^\p{L}\p{N}]')),
    kr as (select item_id, row_number() over (order by r desc, item_id) as place from (select * from k order by r desc, item_id limit 200)),
    q as (select embedding from embeddings where vec_id = 0), v as (select vec_id as item_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s from embeddings e cross join q where vec_id <> 0 order by s desc, vec_id limit 200),
    vr as (select item_id, row_number() over (order by s desc, item_id) as place from v),
    f as (select coalesce(kr.item_id, vr.item_id) as item_id, coalesce(1.0::double / (60 + kr.place), 0) + coalesce(1.0::double / (60 + vr.place), 0) as s, case when kr.place is null then 'vector' when vr.place is null then 'keyword' else 'both' end as matched_by from kr full join vr using (item_id))
    select item_id, round(s, 6) as score, matched_by from f order by s desc, item_id limit 100""",
)
def hybrid_search(spark, folder):
    """Keyword and vector results by reciprocal rank (Q07).  Vectors stand for items of the same id."""
    kw = keyword_search(_texts(spark, folder), "diesel").withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "item_id")))  # at most 200 rows
    v = _vectors(spark, folder)
    vec = nearest(v.where("id = 0").select(F.col("id").alias("query_id"), "vector"), v, 200).select(F.col("id").alias("item_id"), "place")
    return fuse(kw, vec).select("item_id", F.round("score", 6).alias("score"), "matched_by")


@query(
    "story_components",
    """with recursive e as (select article_id as a, min(article_id) over (partition by story_cluster_id) as b from articles where story_cluster_id is not null
      union select article_id, min(article_id) over (partition by title) from articles where title is not null),
    u as (select a, b from e union select b, a from e), w(node, root) as (select a, a from u union select u.a, w.root from u join w on u.b = w.node)
    select node, min(root) as root from w group by 1""",
)
def story_components(spark, folder):
    """Items linked by story or by headline, as connected components (A-D4)."""
    a = table(spark, folder, "articles").select("article_id", "story_cluster_id", "title")
    links = []
    for c in ("story_cluster_id", "title"):
        first = a.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("article_id").alias("b"))
        links.append(a.join(first, c).select(F.col("article_id").alias("a"), "b"))
    return components(links[0].unionByName(links[1]))


@query(
    "story_statistics",
    """select story_cluster_id as root, count(*) as items, count(distinct source_id) filter (where not coalesce(is_syndicated, false)) as independent_sources, min(fetched_at)::date as first_day, max(fetched_at)::date as last_day
    from articles where story_cluster_id is not null group by 1""",
)
def story_stats(spark, folder):
    """Items, independent sources and span of each story."""
    a = table(spark, folder, "articles").where("story_cluster_id is not null")
    rows = a.select("article_id", "source_id", F.coalesce("is_syndicated", F.lit(False)).alias("copy"), F.col("fetched_at").alias("at"))
    roots = a.select(F.col("article_id").alias("node"), F.col("story_cluster_id").alias("root"))
    s = story_statistics(rows.withColumnRenamed("article_id", "item_id"), roots)
    return s.select("root", "items", "independent_sources", F.to_date("first_seen").alias("first_day"), F.to_date("last_seen").alias("last_day"))


@query("exact_duplicates")
def exact_duplicate_items(spark, folder):
    """Items with the same title and text, by anchors of 48 hours (A-D1); order-dependent, tested against a plain loop."""
    rows = table(spark, folder, "raw_items").select("item_id", "source_id", F.col("fetched_at").alias("at"), content_hash(F.col("title"), F.col("summary")).alias("hash"))
    return exact_duplicates(rows)


def _topic_docs(spark, folder):
    return items(spark, folder).where("primary_category is not null and title is not null").select(F.col("primary_category").alias("topic"), F.col("article_id").alias("item_id"), F.col("title").alias("text"))


_TERMS = r"""with d as (select primary_category as topic, article_id as item_id, title from {items} a where primary_category is not null and title is not null),
w as (select topic, item_id, unnest(regexp_extract_all(lower(replace(title, 'İ', 'i' || chr(775))), '\p{L}\p{L}+')) as term from d), n as (select topic, item_id, term, count(*) as n from w group by 1, 2, 3),
nd as (select count(*) as nd from d), df as (select term from n group by 1 having count(distinct item_id) >= 2 and count(distinct item_id) <= (select nd from nd) * 0.5),
tf as (select topic, term, cast(sum(n) as double) as tf from n where term in (select term from df) group by 1, 2), pt as (select topic, sum(tf) as al from tf group by 1), av as (select avg(al) as av from pt), ov as (select term, sum(tf) as total from tf group by 1),
s as (select topic, term, tf / al * ln(1 + av / total) as weight from tf join pt using (topic) join ov using (term) cross join av), r as (select *, row_number() over (partition by topic order by round(weight, 9) desc, term) as place from s)"""


@query("ctfidf_terms", _TERMS + " select topic, term, round(weight, 6) as weight, place from r where place <= 10")
def ctfidf_terms(spark, folder):
    """The ten words that mark each category's headlines (A-T5)."""
    docs = _topic_docs(spark, folder)
    top = class_tfidf(document_terms(docs, bigrams=False), docs.count())
    return top.select("topic", "term", F.round("weight", 6).alias("weight"), F.col("place").cast("long").alias("place"))


@query("topic_coherence")
def topic_coherence(spark, folder):
    """Coherence of each category's words (A-T6); tested against a plain computation."""
    docs = _topic_docs(spark, folder)
    n = docs.count()
    terms = document_terms(docs, bigrams=False)
    return coherence(terms, class_tfidf(terms, n), n)


@query("kmeans_topics")
def kmeans_topics_query(spark, folder):
    """Clusters of the vectors (A-T3); invariants are tested."""
    return kmeans_topics(_vectors(spark, folder))
