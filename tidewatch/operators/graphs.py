"""Stories as connected components, and what follows from them (A-D1, A-D4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import cut


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large-star and small-star steps.

    Every step is a grouped aggregation over edges; the number of steps grows with the logarithm of the longest chain.
    A node of very many edges is never gathered: each step needs the least neighbour only.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = links.select("u").union(links.select("v")).distinct()
    now = cut(links.where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        # Equal numbers of distinct edges and equal sums of their 64-bit hashes: nothing has changed.
        if _digest(now) == _digest(after):
            break
        now = after
    return nodes.withColumnRenamed("u", "node").join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


_ANCHORED = "item_id long, anchor_id long, kind string"


def _anchor(hours: int):
    """Rows sorted by hash, time and id, one after the other: only the anchor of the hash at hand is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor, since, owner = None, None, None, None
        for b in batches:
            out = []
            for content, i, at, source in zip(b["hash"], b["item_id"], b["us"], b["source_id"]):
                if content != now or source != owner and at - since > hours * 3_600_000_000:
                    now, anchor, since, owner = content, i, at, source
                else:
                    out.append((i, anchor, "duplicate" if source == owner else "syndicated_from"))
            yield pd.DataFrame(out, columns=["item_id", "anchor_id", "kind"])

    return run


def exact_duplicates(items: DataFrame, hours: int = 48) -> DataFrame:
    """(item_id, anchor_id, kind) in order of time: copies of the first item with the same content (A-D1).

    ``items``: item_id, source_id, at, hash.  Copies of the same source are duplicates; of another source syndicated,
    or, more than ``hours`` after the anchor, the next anchor.  Hashes that occur once never leave the JVM; the narrow rows
    of one hash are streamed through one task, as each anchor depends on the one before.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "source_id", F.unix_micros("at").alias("us"), "hash").where("hash is not null and us is not null")
    again = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    return rows.join(again, "hash", "left_semi").repartition("hash").sortWithinPartitions("hash", "us", "item_id").mapInPandas(_anchor(hours), _ANCHORED)


def story_statistics(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Per story: items, independent sources (copies aside), first and last time."""
    return items.join(roots.select(F.col("node").alias("item_id"), "root"), "item_id").groupBy("root").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct(F.when(~F.col("copy"), F.col("source_id"))).alias("independent_sources"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")
    )


def reuse_ids(roots: DataFrame, before: DataFrame) -> DataFrame:
    """(root, story_id): a story keeps the id its earliest member had; of several claims the one with the least root wins."""
    claims = roots.join(before.select(F.col("node"), F.col("story_id").alias("old")), "node").groupBy("root").agg(F.min_by("old", "node").alias("old"))
    winners = claims.groupBy("old").agg(F.min("root").alias("root"))
    return roots.select("root").distinct().join(winners, "root", "left").select("root", F.coalesce("old", "root").alias("story_id"))
