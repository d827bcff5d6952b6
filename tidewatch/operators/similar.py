"""Near duplicates of headlines (A-D2) and semantic links (A-D3), as blocked joins with time windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions.text import indel_similarity, token_set_similarity
from tidewatch.functions.vectors import cosine
from tidewatch.session import cut

HORIZON, REPOST = 48 * 3600, 12 * 3600


PLACES = 1024


def _pieces(title: str) -> tuple[np.ndarray, np.ndarray, int, frozenset, frozenset]:
    """Counts of the letter pairs of a title's different words, roots of the words' lengths, the joined words' length, and
    the numbered letter pairs and letters themselves.

    The first two go by hash: where two fall on one place, the product of two such rows is larger, never smaller.
    """
    pairs, words = np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32)
    seen: Counter = Counter()
    length = -1
    for w in set(title.split()):
        length += len(w) + 1
        words[xxhash.xxh32_intdigest(w) % PLACES] += (len(w) + 1) ** 0.5
        seen.update(map("".join, zip(f" {w}", f"{w} ")))
    for piece, n in seen.items():
        for k in range(n):
            pairs[xxhash.xxh32_intdigest(piece, seed=k) % PLACES] += 1
    letters = Counter(" ".join(set(title.split())))
    return pairs, words, length, *(frozenset((x, k) for x, n in c.items() for k in range(n)) for c in (seen, letters))


def _may_agree(least: float, chunk: int = 512):
    """(item_id, other_id): the pairs of a key that can reach ``least`` by their words or letters; rows come sorted by key.

    A token set similarity of ``least`` comes from the common words alone, which then make up least / (200 - least) of one
    title's words, or from a common subsequence of least / 200 of both titles' letters; every letter outside it destroys
    at most two letter pairs of its own title or one of the other, so (3 least / 200 - 1) of both lengths are in common.
    """

    def within(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        new, old = ([r[1:] for r in rows if r[0] == flag] for flag in (True, False))
        if not new or not old:
            return
        (*of_new, two_n, one_n), (*of_old, two_o, one_o) = (zip(*(_pieces(r[2]) for r in x)) for x in (new, old))
        (pn, wn, ln), (po, wo, lo) = map(np.array, of_new), map(np.array, of_old)
        (i, s), (j, so) = (map(np.array, zip(*(r[:2] for r in x))) for x in (new, old))
        for k in range(0, len(new), chunk):
            at = slice(k, k + chunk)
            gap = s[at, None] - so[None, :]
            ok = (gap >= 0) & (gap <= HORIZON) & ((gap > 0) | (j[None, :] < i[at, None]))
            short = np.minimum(ln[at, None], lo[None, :])
            by_words = wn[at] @ wo.T - 1 >= least / (200 - least) * short - 0.01
            both = ln[at, None] + lo[None, :]
            by_letters = pn[at] @ po.T - 1 >= (3 * least / 200 - 1) * both - 0.01
            x, y = np.nonzero(ok & by_letters & ~by_words)
            kept = [len(two_n[k + a] & two_o[b]) - 1 >= (3 * least / 200 - 1) * both[a, b] - 0.01 and len(one_n[k + a] & one_o[b]) >= least / 200 * both[a, b] - 0.01 for a, b in zip(x, y)]
            x, y = (np.concatenate(z) for z in zip(np.nonzero(ok & by_words), (x[np.array(kept, dtype=bool)], y[np.array(kept, dtype=bool)])))
            if len(x):
                yield pd.DataFrame({"item_id": i[at][x], "other_id": j[y]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            for bucket, part, *row in zip(*(b[c] for c in ("bucket", "part", "newer", "item_id", "s", "title"))):
                if (bucket, part) != key:
                    yield from within(held)
                    key, held = (bucket, part), []
                held.append(tuple(row))
        yield from within(held)

    return run


def near_duplicates(items: DataFrame, least_title: float = 88.0, links: int = 3, most: int = 4000) -> DataFrame:
    """(item_id, other_id, kind, score): what each item repeats of the 48 hours before it.

    ``items``: item_id, source_id, at, language, title, text (matching forms).  All headlines of four words or more
    within 48 hours are held against bounds of their similarity (in parts of ``most`` newer ones), and what can reach
    ``least_title`` is compared; a link goes to an older item only.  Of one source: duplicate if the texts agree to 95 or
    within 12 hours.  Of another: syndicated if the texts agree to 90, or without text if the headlines agree to 97 in
    one language; the earliest copy counts.  Then up to ``links`` of the same story by score.  Ties go to the lower id.
    """
    rows = items.where((F.size(F.split("title", " ")) >= 4) & F.col("at").isNotNull()).select(
        "item_id", "source_id", "language", "title", F.coalesce("text", F.lit("")).alias("text"), F.unix_timestamp("at").alias("s")
    )
    rows = cut(rows)  # the forms come from Python and are read three times
    here = rows.select("item_id", "s", "title", F.floor(F.col("s") / HORIZON).alias("bucket"))
    sizes = here.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    newer = here.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"), F.lit(True).alias("newer"), "item_id", "s", "title")
    older = here.select(F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), "item_id", "s", "title").join(sizes, "bucket")
    older = older.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("newer"), "item_id", "s", "title")
    kind = rows.schema["item_id"].dataType.simpleString()
    # A task a bucket and part, even where the tables are small.
    spread = newer.unionByName(older).repartition(rows.sparkSession.sparkContext.defaultParallelism * 4, "bucket", "part").sortWithinPartitions("bucket", "part")
    met = spread.mapInPandas(_may_agree(least_title), f"item_id {kind}, other_id {kind}")
    o = rows.select(F.col("item_id").alias("other_id"), F.col("source_id").alias("source_o"), F.col("language").alias("language_o"), F.col("title").alias("title_o"), F.col("text").alias("text_o"), F.col("s").alias("so"))
    pairs = met.join(rows, "item_id").join(o, "other_id").withColumn("t", token_set_similarity("title", "title_o")).where(F.col("t") >= least_title)
    pairs = pairs.withColumn("b", F.when((F.col("text") != "") & (F.col("text_o") != ""), indel_similarity("text", "text_o")))
    own = F.col("source_id").eqNullSafe(F.col("source_o"))
    duplicate = own & ((F.coalesce("b", F.lit(0.0)) >= 95) | (F.col("s") - F.col("so") <= REPOST))
    copied = ~own & ((F.coalesce("b", F.lit(0.0)) >= 90) | (F.col("b").isNull() & (F.col("t") >= 97) & F.col("language").eqNullSafe(F.col("language_o"))))
    scored = pairs.select("item_id", "other_id", "so", (F.col("t") + F.coalesce("b", F.lit(0.0))).alias("score"), F.when(duplicate, 1).when(copied, 2).otherwise(3).alias("class"))
    order = [F.when(F.col("class") == 2, F.col("so")).otherwise(F.lit(0)), F.desc("score"), "other_id"]
    ranked = scored.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "class").orderBy(*order)))
    best = F.min("class").over(Window.partitionBy("item_id"))
    chosen = ranked.withColumn("best", best)
    main = chosen.where("class = best and class < 3 and n = 1")
    stories = chosen.join(main.select("item_id", "other_id"), ["item_id", "other_id"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "other_id"))).where(F.col("k") <= links)
    kind = F.when(F.col("class") == 1, "duplicate").otherwise("syndicated_from")
    return main.select("item_id", "other_id", kind.alias("kind"), "score").unionByName(stories.select("item_id", "other_id", F.lit("same_story").alias("kind"), "score"))


def semantic_links(items: DataFrame, same: float, related: float, days: int = 4, k: int = 10) -> DataFrame:
    """(item_id, other_id, kind, similarity): the ``k`` nearest older vectors within ``days`` that are similar enough.

    ``items``: item_id, source_id, at, vector.  Same story needs another source.  Order is (time, id), so a pair of
    equal times gives one link.
    """
    span = days * 86_400
    rows = items.where(F.col("at").isNotNull() & F.col("vector").isNotNull()).select("item_id", "source_id", "vector", F.unix_timestamp("at").alias("s"))
    here = rows.withColumn("bucket", F.floor(F.col("s") / span))
    older = rows.select(F.col("item_id").alias("other_id"), F.col("source_id").alias("source_o"), F.col("vector").alias("v"), F.col("s").alias("so"), F.explode(F.array(F.floor(F.col("s") / span), F.floor(F.col("s") / span) + 1)).alias("bucket"))
    met = here.join(older, "bucket").where(f"(so < s or (so = s and other_id < item_id)) and s - so <= {span}")
    scored = met.select("item_id", "other_id", (F.col("source_id") != F.col("source_o")).alias("apart"), cosine(F.col("vector"), F.col("v")).alias("similarity")).where(F.col("similarity") >= related)
    near = scored.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("similarity"), "other_id"))).where(F.col("n") <= k)
    return near.select("item_id", "other_id", F.when((F.col("similarity") >= same) & F.col("apart"), "same_story").otherwise("similar").alias("kind"), "similarity")


def model_stage(items: DataFrame, done: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Results of a model for the contents that have none yet (N6): ``run`` gets Arrow batches of (content_hash, text)."""
    fresh = items.select("content_hash", "text").dropDuplicates(["content_hash"]).join(done.select("content_hash"), "content_hash", "left_anti")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (run(p) for p in parts if len(p))

    return fresh.mapInPandas(batches, schema)


def apply_corrections(measures: DataFrame, corrections: DataFrame) -> DataFrame:
    """Measures with decided corrections as the current rows (A-C1): method human, confidence 1; earlier rows stay, retired.

    ``measures``: item_id, measure, value, method, confidence, version.  ``corrections``: item_id, measure, value, decided_at.
    """
    last = corrections.where(F.col("measure").isin("sentiment", "category", "frame")).groupBy("item_id", "measure").agg(F.max_by("value", F.struct("decided_at", "value")).alias("value"))
    top = measures.groupBy("item_id", "measure").agg(F.max("version").alias("v"))
    human = last.join(top, ["item_id", "measure"], "left").select("item_id", "measure", "value", F.lit("human").alias("method"), F.lit(1.0).alias("confidence"), (F.coalesce("v", F.lit(0)) + 1).cast(measures.schema["version"].dataType).alias("version"))
    w = Window.partitionBy("item_id", "measure").orderBy(F.desc("version"))
    return measures.select(*human.columns).unionByName(human).withColumn("is_current", F.row_number().over(w) == 1)
