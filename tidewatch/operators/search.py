"""Keyword, substring, vector and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.vectors import cosine, unit


def parse_query(text: str) -> list[list[tuple[bool, str]]]:
    """Web-search syntax to alternatives of (wanted, phrase): words are joined by AND, ``or`` splits, ``-`` negates, quotes hold."""
    out: list[list[tuple[bool, str]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        phrase = (quoted or word).strip().lower()
        if not quoted and phrase == "or":
            out.append([])
        elif phrase:
            out[-1].append((minus != "-", phrase))
    return [alt for alt in out if alt]


def matches(text: Column, query: str) -> Column:
    """Whether the words of the text satisfy the query; no stemming, no stop words."""
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))
    whole = F.lit(False)
    for alt in parse_query(query):
        one = F.lit(True)
        for wanted, phrase in alt:
            words = " ".join(re.findall(r"[^\W_]+", phrase))
            hit = padded.contains(f" {words} ")
            one = one & (hit if wanted else ~hit)
        whole = whole | one
    return F.coalesce(whole, F.lit(False))


def keyword_rank(title: Column, text: Column, query: str) -> Column:
    """Weighted term frequency: 1 per hit in the title, 0.4 per hit in the text, damped by length."""
    total = F.lit(0.0)
    for alt in parse_query(query):
        for wanted, phrase in alt:
            if wanted:
                pattern = r"(?<![\p{L}\p{N}])" + re.escape(phrase) + r"(?![\p{L}\p{N}])"
                total = total + F.regexp_count(F.lower(F.coalesce(title, F.lit(""))), F.lit(pattern)) + 0.4 * F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern))
    return total / (1 + F.log1p(F.length(F.coalesce(text, F.lit(""))).cast("double")))


def keyword_search(items: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """(item_id, rank): the best ``limit`` items; where no word matches, those that hold the query as a substring."""
    both = F.concat_ws(" ", "title", "text")
    found = items.where(matches(both, query)).select("item_id", keyword_rank(F.col("title"), F.col("text"), query).alias("rank"))
    plain = items.where(F.lower(both).contains(query.lower())).select("item_id", F.lit(0.0).alias("rank"))
    some = found.limit(1).agg(F.count(F.lit(1)).alias("some"))
    either = found.unionByName(plain.crossJoin(F.broadcast(some)).where("some = 0").drop("some"))
    return either.orderBy(F.desc("rank"), "item_id").limit(limit)


def _in_blocks(few: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``few`` cut by hash into as many parts as keep each at about ``most`` rows, which is what may be broadcast at once."""
    parts = max(1, -(-few.count() // most))
    return [few.where(F.pmod(F.xxhash64(key), F.lit(parts)) == n) for n in range(parts)] if parts > 1 else [few]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 10_000) -> DataFrame:
    """(query_id, id, similarity): the k most similar vectors of each query, exact.

    ``queries`` is a stated set, sent to all rows in blocks of about ``block``; each partition of the vectors keeps k per
    query before anything is shuffled.
    """
    out = None
    for part in _in_blocks(queries, "query_id", block):
        scored = vectors.select("id", "vector").crossJoin(F.broadcast(part.select("query_id", F.col("vector").alias("q")))).where("id <> query_id").select("query_id", "id", cosine(F.col("vector"), F.col("q")).alias("similarity"))
        scored = scored.where("similarity is not null").withColumn("part", F.spark_partition_id())
        local = Window.partitionBy("query_id", "part").orderBy(F.desc("similarity"), "id")
        final = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        kept = scored.withColumn("n", F.row_number().over(local)).where(F.col("n") <= k)
        top = kept.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).select("query_id", "id", "similarity", "place")
        out = top if out is None else out.unionByName(top)
    return out


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, centroid): the mean vector of each group at length 1 (G22), by one aggregation per dimension."""
    parts = vectors.select(by, F.posexplode("vector").alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("mean"))
    return mean.select(by, unit(F.col("mean")).alias("centroid"))


def assign(vectors: DataFrame, centers: DataFrame, by: str, least: float = 0.0, block: int = 10_000) -> DataFrame:
    """(id, by, similarity): the nearest centroid of each vector at or above ``least`` (J16); centroids go out in blocks."""
    scored = None
    for part in _in_blocks(centers, by, block):
        one = vectors.select("id", "vector").crossJoin(F.broadcast(part)).select("id", by, cosine(F.col("vector"), F.col("centroid")).alias("similarity"))
        scored = one if scored is None else scored.unionByName(one)
    best = scored.groupBy("id").agg(F.max(F.struct("similarity", F.negative(F.col(by)).alias("tie"))).alias("b"))
    return best.select("id", F.negative(F.col("b.tie")).alias(by), F.col("b.similarity").alias("similarity")).where(F.col("similarity") >= least)


def fuse(keyword: DataFrame, vector: DataFrame, limit: int = 100, k: int = 60) -> DataFrame:
    """(item_id, score, matched_by): reciprocal rank fusion of two ranked lists (item_id, place from 1)."""
    a = keyword.select("item_id", (1.0 / (k + F.col("place"))).alias("ka"))
    b = vector.select("item_id", (1.0 / (k + F.col("place"))).alias("vb"))
    both = a.join(b, "item_id", "full")
    by = F.when(F.col("ka").isNull(), "vector").when(F.col("vb").isNull(), "keyword").otherwise("both")
    return both.select("item_id", (F.coalesce("ka", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0))).alias("score"), by.alias("matched_by")).orderBy(F.desc("score"), "item_id").limit(limit)
