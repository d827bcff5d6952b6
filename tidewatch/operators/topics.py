"""Topics: class-based term weights, coherence, clustering, alignment (A-T3 to A-T9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions.vectors import dot


def document_terms(docs: DataFrame, stop: list[str] = (), bigrams: bool = True) -> DataFrame:
    """(topic, item_id, term, n): words of two and more letters and pairs of them."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    both = F.concat(F.col("w"), F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>")))
    terms = docs.select("topic", "item_id", words.alias("w")).select("topic", "item_id", F.explode(both if bigrams else F.col("w")).alias("term"))
    return terms.groupBy("topic", "item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def class_tfidf(terms: DataFrame, documents: int, top: int = 10) -> DataFrame:
    """(topic, term, weight, place): the terms that mark each topic (A-T5).

    Terms of fewer than 2 documents (1 if there are fewer than 50 documents) or more than half of them are left out.
    """
    df = terms.groupBy("term").agg(F.countDistinct("item_id").alias("df"))
    kept = df.where((F.col("df") >= (2 if documents >= 50 else 1)) & (F.col("df") <= max(1, documents * 0.5))).select("term")
    tf = terms.join(kept, "term").groupBy("topic", "term").agg(F.sum("n").cast("double").alias("tf"))
    per_topic = tf.groupBy("topic").agg(F.sum("tf").alias("all_tf"))
    average = per_topic.agg(F.avg("all_tf").alias("average"))
    overall = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    weight = F.col("tf") / F.col("all_tf") * F.log(1 + F.col("average") / F.col("total"))
    scored = tf.join(per_topic, "topic").join(overall, "term").crossJoin(F.broadcast(average)).select("topic", "term", weight.alias("weight"))
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def coherence(terms: DataFrame, chosen: DataFrame, documents: int) -> DataFrame:
    """(topic, npmi): mean normalised pointwise mutual information of the pairs of a topic's terms, -1 for pairs that never meet (A-T6)."""
    has = terms.select("item_id", "term").distinct()
    marked = has.join(chosen.select("topic", "term"), "term")
    single = marked.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    met = marked.join(marked.select("item_id", "topic", F.col("term").alias("other")), ["item_id", "topic"]).where("term < other").groupBy("topic", "term", "other").agg(F.count(F.lit(1)).cast("double").alias("nij"))
    pairs = chosen.select("topic", "term").join(chosen.select("topic", F.col("term").alias("other")), "topic").where("term < other")
    joined = pairs.join(met, ["topic", "term", "other"], "left").join(single.select("topic", "term", F.col("n").alias("ni")), ["topic", "term"], "left").join(single.select("topic", F.col("term").alias("other"), F.col("n").alias("nj")), ["topic", "other"], "left")
    p = F.col("nij") / documents
    value = F.when(F.col("nij").isNull(), -1.0).when(p >= 1, 1.0).otherwise(F.log(p * documents * documents / (F.col("ni") * F.col("nj"))) / -F.log(p))
    return joined.groupBy("topic").agg(F.avg(value).alias("npmi"))


def topic_count(n: int) -> int:
    return min(max(round(math.sqrt(n / 2)), 3), 40)


def kmeans_topics(vectors: DataFrame, seed: int = 42, runs: int = 10) -> DataFrame:
    """(id, topic, probability): k-means on unit vectors, the best of some seeds; probability 1 / (1 + distance) (A-T3)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = vectors.count()
    data = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features")).repartition("id")
    models = [KMeans(k=topic_count(n), seed=seed + i, maxIter=30, initMode="k-means||").fit(data) for i in range(runs)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "topic int, center array<double>")
    placed = best.transform(data).select("id", F.col("prediction").alias("topic"), vector_to_array("features").alias("v")).join(F.broadcast(centers), "topic")
    gap = F.zip_with("v", "center", lambda x, y: x - y)
    return placed.select("id", "topic", (1 / (1 + F.sqrt(dot(gap, gap)))).alias("probability"))


def align(local: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """(topic, global_id, similarity, new): each topic's best known topic by centroid (A-T9).

    A topic below ``least`` becomes a known one itself, with the ids after the highest one, in the order of topics.
    """
    scored = local.crossJoin(known).select("topic", "global_id", dot(F.col("centroid"), F.col("global_centroid")).alias("similarity"))
    best = scored.groupBy("topic").agg(F.max_by(F.struct("global_id", "similarity"), F.struct("similarity", F.negative("global_id"))).alias("b"))
    placed = local.select("topic").join(best, "topic", "left").select("topic", F.when(F.col("b.similarity") >= least, F.col("b.global_id")).alias("global_id"), F.col("b.similarity").alias("similarity"))
    highest = known.agg(F.coalesce(F.max("global_id"), F.lit(0)).alias("highest"))
    fresh = placed.where("global_id is null").withColumn("n", F.row_number().over(Window.orderBy("topic")))  # topics are few
    fresh = fresh.crossJoin(F.broadcast(highest)).select("topic", (F.col("highest") + F.col("n")).cast(known.schema["global_id"].dataType).alias("global_id"), "similarity", F.lit(True).alias("new"))
    return placed.where("global_id is not null").select("topic", "global_id", "similarity", F.lit(False).alias("new")).unionByName(fresh)


def fit_metrics(assigned: DataFrame, terms: DataFrame, npmi: DataFrame, outlier: int = -1) -> DataFrame:
    """One row about a fitted model (A-T7): topics, share of items without one, coherence, diversity of the topics' terms.

    ``assigned``: item_id, topic.  ``terms``: topic, term.  ``npmi``: topic, npmi.
    """
    real = F.col("topic") != outlier
    a = assigned.agg(F.countDistinct(F.when(real, F.col("topic"))).alias("topics"), F.avg(F.when(real, 0.0).otherwise(1.0)).alias("outlier_share"))
    t = terms.agg(F.try_divide(F.countDistinct("term").cast("double"), F.count(F.lit(1))).alias("diversity"))
    return a.crossJoin(npmi.agg(F.avg("npmi").alias("coherence"))).crossJoin(t)


def needs_refit(age_days: int | None, now: int, then: int) -> bool:
    """Whether a topic model is fitted again: none, a week old, or 1.3 times the items."""
    return age_days is None or age_days >= 7 or now > 1.3 * then


def corpus(items: DataFrame, at: str = "fetched_at", days: int = 90, most: int = 20_000, categories: list[str] | None = None) -> DataFrame:
    """The items that a topic model is fitted on (A-T10): of the last ``days``, no copies, the newest ``most`` of them.

    ``most`` is the bound of a model's training sample; every item is assigned afterwards.
    """
    last = items.agg(F.max(at).alias("last"))
    rows = items.where(~F.coalesce("is_syndicated", F.lit(False))).crossJoin(F.broadcast(last)).where(F.col(at) >= F.col("last") - F.make_interval(days=F.lit(days))).drop("last")
    if categories is not None:
        rows = rows.where(F.col("primary_category").isin(*categories))
    return rows.orderBy(F.desc(at), "article_id").limit(most)
