"""Dictionary-based analysis of texts: sentiment, emotions, frames, categories, mentions, events.

Vocabularies are inputs: small tables (class, term) that become one index of terms, in which a text looks up its words.
Texts and terms meet in their matching form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.terms import TermIndex, class_hits, index_of
from tidewatch.functions.text import fold_text, sentences
from tidewatch.functions.vectors import cosine


def sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """Struct of label, shares and confidence."""
    counts = F.transform(class_hits(text, {"positive": positive, "negative": negative}), lambda n: n.cast("double"))
    # Counted once, although the formula uses the counts many times.
    return F.transform(F.array(counts), lambda c: _sentiment(c[0], c[1]))[0]


def _sentiment(p: Column, n: Column) -> Column:
    total = p + n
    none = total == 0
    up, down = (p + 0.5) / (total + 1), (n + 0.5) / (total + 1)
    strength = F.least(F.lit(1.0), total / 4)
    pos = F.when(none, 0.1).otherwise(F.round(up * strength, 4))
    neg = F.when(none, 0.1).otherwise(F.round(down * strength, 4))
    neutral = F.when(none, 0.8).otherwise(F.round(F.greatest(1 - pos - neg, F.lit(0.0)), 4))
    # How far the shares are apart before they are weakened by few hits.
    sure = F.when(none, 0.4).otherwise(F.round(F.least(F.lit(0.7), 0.35 + 0.1 * total) * (0.6 + 0.4 * F.abs(up - down)), 4))
    label = F.when((pos >= neg) & (pos >= neutral), "positive").when(neg >= neutral, "negative").otherwise("neutral")
    label = F.when(sure < 0.35, "uncertain").otherwise(label)
    return F.struct(label.alias("label"), pos.alias("positive"), neutral.alias("neutral"), neg.alias("negative"), sure.alias("confidence"))


def shares(text: Column, classes: dict[str, list[str]]) -> Column:
    """Struct of the leading class, the share of each and a confidence (N8); class none without any term."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(F.array(class_hits(text, classes)), lambda n: _shares(n, names))[0]


def _shares(n: Column, names: Column) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda acc, x: acc + x)
    scores = F.transform(n, lambda x: F.coalesce(F.round(F.try_divide(x.cast("double"), total), 4), F.lit(0.0)))
    top = F.array_max(scores)
    label = F.when(total > 0, F.element_at(names, F.array_position(scores, top).cast("int"))).otherwise("none")
    sure = F.when(total > 0, F.round(F.least(F.lit(0.65), 0.3 + 0.1 * total) * top, 4)).otherwise(0.3)
    return F.struct(label.alias("label"), F.map_from_arrays(names, scores).alias("scores"), sure.alias("confidence"))


def evidence(text: Column, classes: dict[str, list[str]], most: int = 10) -> Column:
    """The first ``most`` terms of any class that stand in the text, in the order of the vocabulary."""
    flat = tuple(t for ts in classes.values() for t in ts)

    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        index = index_of(flat)
        return s.map(lambda x: [flat[k] for k in sorted({k for k, _, _ in index.find(fold_text(x))})[:most]])

    return found(text)


# Labels of sentiment models by the label that they stand for.
MODEL_LABELS = {"positive": "positive pos label_2", "neutral": "neutral neu label_1", "negative": "negative neg label_0"}


def model_label(label: Column) -> Column:
    """The sentiment that a model's label stands for (N9); null for other labels."""
    return F.try_element_at(F.create_map(*[F.lit(x) for ours, theirs in MODEL_LABELS.items() for t in theirs.split() for x in (t, ours)]), F.lower(label))


def frames(items: DataFrame, cues: dict[str, list[str]], least: float = 0.35) -> DataFrame:
    """(item_id, frame, cues, score, confidence, evidence): per frame the sentence with most cues, the first on a tie."""
    cut = items.select("item_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    named = F.arrays_zip(F.array(*[F.lit(f) for f in cues]).alias("frame"), class_hits(F.col("sentence"), cues).alias("n"))
    found = cut.select("item_id", "pos", "sentence", F.explode(named).alias("c")).where("c.n > 0").select("item_id", "pos", "sentence", "c.frame", "c.n")
    out = found.groupBy("item_id", "frame").agg(F.sum("n").alias("cues"), F.max_by("sentence", F.struct("n", F.negative("pos"))).alias("evidence"))
    score = F.least(F.lit(1.0), 0.3 + 0.2 * F.col("cues"))
    return out.select("item_id", "frame", "cues", score.alias("score"), F.least(F.lit(0.65), 0.8 * score).alias("confidence"), "evidence").where(F.col("score") >= least)


def category_scores(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, category, leaf, score): 2 per headline hit up to 2, 1 per body hit up to 3; a parent gets half of its children.

    ``terms``: category, parent, term; a vocabulary that the driver holds and sends to the tasks as one index.
    """
    listed = [(r["category"], r["parent"], r["term"]) for r in terms.orderBy("category", "term").collect()]
    words = tuple(t for _, _, t in listed)
    parents = {c: p for c, p, _ in listed}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_of(words)
        for b in batches:
            out = []
            for item, title, body in zip(b["item_id"], b["title"], b["text"]):
                points: dict[str, float] = {}
                for (category, _, _), t, x in zip(listed, index.counts(fold_text(title)), index.counts(fold_text(body))):
                    if t or x:
                        points[category] = points.get(category, 0.0) + 2 * min(t, 2) + min(x, 3)
                out += [(item, c, n) for c, n in points.items()]
            yield pd.DataFrame(out, columns=["item_id", "category", "score"])

    kind = items.schema["item_id"].dataType.simpleString()
    parent = F.create_map(*[F.lit(x) for c, p in parents.items() if p for x in (c, p)]) if any(parents.values()) else F.create_map(F.lit(""), F.lit(""))
    leaf = items.select("item_id", "title", "text").mapInPandas(run, f"item_id {kind}, category string, score double").withColumn("parent", F.try_element_at(parent, "category"))
    up = leaf.where("parent is not null").select("item_id", F.col("parent").alias("category"), (F.col("score") * 0.5).alias("score"))
    both = leaf.select("item_id", "category", F.col("parent").isNotNull().alias("leaf"), "score").unionByName(up.select("item_id", "category", F.lit(False).alias("leaf"), "score"))
    return both.groupBy("item_id", "category").agg(F.max("leaf").alias("leaf"), F.sum("score").alias("score"))


#: Above this similarity a category's prototype adds to its score, up to ``PROTOTYPE_BONUS`` for an equal vector.
PROTOTYPE_FROM, PROTOTYPE_BONUS = 0.80, 4.0


def with_prototypes(scores: DataFrame, vectors: DataFrame, prototypes: DataFrame, least: float = PROTOTYPE_FROM) -> DataFrame:
    """``category_scores`` with the bonus of categories whose prototype is close to the item's vector.

    ``vectors``: item_id, vector.  ``prototypes``: category, leaf, prototype; as many as there are categories.
    """
    near = vectors.crossJoin(prototypes.hint("broadcast")).withColumn("similarity", cosine(F.col("vector"), F.col("prototype"))).where(F.col("similarity") > least)
    bonus = near.select("item_id", "category", "leaf", (PROTOTYPE_BONUS * (F.col("similarity") - least) / (1 - least)).alias("score"))
    return scores.select("item_id", "category", "leaf", "score").unionByName(bonus).groupBy("item_id", "category").agg(F.max("leaf").alias("leaf"), F.sum("score").alias("score"))


def classify(scores: DataFrame) -> DataFrame:
    """(item_id, category, rank, confidence, route): the primary category and up to three secondary ones."""
    pool = scores.withColumn("any_leaf", F.max("leaf").over(Window.partitionBy("item_id"))).where("leaf or not any_leaf")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "category")
    ranked = pool.select("item_id", "category", "score", F.row_number().over(w).alias("place"), F.first("score").over(w).alias("top"))
    second = ranked.groupBy("item_id").agg(F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    sure = F.least(F.lit(0.97), (1 - F.exp(-F.col("top") / 3)) * (0.55 + 0.45 * (F.col("top") - F.col("second")) / F.col("top")))
    joined = ranked.join(second, "item_id").withColumn("sure", sure)
    kept = joined.where((F.col("place") == 1) & (F.col("sure") >= 0.3) | F.col("place").between(2, 6) & (F.col("score") >= 0.5 * F.col("top")))
    w2 = Window.partitionBy("item_id").orderBy("place")
    out = kept.withColumn("n", F.row_number().over(w2)).where("n <= 4")
    return out.select(
        "item_id", "category", F.when(F.col("place") == 1, "primary").otherwise("secondary").alias("rank"), (F.col("sure") * F.col("score") / F.col("top")).alias("confidence"),
        F.when(F.col("sure") >= 0.85, "accepted").when(F.col("sure") >= 0.60, "secondary").otherwise("review").alias("route"),
    )


_MENTION = "item_id long, entity_id int, alias_id int, surface string, start int, stop int, sentence string"


def _gazetteer(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Longest alias first, then the lowest id.
        listed = sorted(shared.value, key=lambda x: (-len(x[2]), x[0]))
        index = TermIndex([form for _, _, form in listed])
        for b in batches:
            out = []
            for item, text in zip(b["item_id"], b["text"]):
                parts = [(fold_text(s), s) for s in map(str.strip, re.split(r"(?<=[.!?؟。])\s+|\n+", text)) if s]
                form = fold_text(text)
                taken: list[tuple[int, int, int]] = []
                for k, start, stop in sorted(index.find(form)):
                    if all(stop <= s or start >= e for s, e, _ in taken):
                        taken.append((start, stop, k))
                for start, stop, k in sorted(taken):
                    alias, entity, _ = listed[k]
                    surface = form[start:stop]
                    sentence = next((s for f, s in parts if surface in f), parts[0][1] if parts else None)
                    # The matching form keeps the places of most texts' characters.
                    out.append((item, entity, alias, text[start:stop] if len(text) == len(form) else surface, start, stop, sentence))
            yield pd.DataFrame(out, columns=["item_id", "entity_id", "alias_id", "surface", "start", "stop", "sentence"])

    return run


def mentions(items: DataFrame, aliases: DataFrame, least_length: int = 3, most_aliases: int = 500_000) -> DataFrame:
    """Mentions of listed aliases, longest first without overlap (N11), as places of the text's matching form.

    ``aliases``: alias_id, entity_id, form.  A vocabulary goes out to the tasks as one index; one of more than
    ``most_aliases`` goes out in parts by the first letter of the form, and overlaps are settled between them after.
    """
    rows = aliases.where(F.length("form") >= least_length).select("alias_id", "entity_id", "form").distinct()
    texts = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = -(-rows.count() // most_aliases)
    part = F.pmod(F.xxhash64(F.lower(F.substring("form", 1, 1))), F.lit(max(parts, 1)))
    found = None
    for n in range(max(parts, 1)):
        listed = [tuple(r) for r in rows.where(part == n).collect()]
        one = texts.mapInPandas(_gazetteer(items.sparkSession.sparkContext.broadcast(listed)), _MENTION)
        found = one if found is None else found.unionByName(one)
    if parts <= 1:
        return found
    lengths = rows.groupBy("alias_id").agg(F.max(F.length("form")).alias("length"))
    ranked = found.join(lengths, "alias_id").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(F.negative("length").alias("l"), "alias_id", "entity_id", "surface", "start", "stop", "sentence"))).alias("all"))
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ranked.select("item_id", F.explode(kept).alias("x")).select("item_id", "x.entity_id", "x.alias_id", "x.surface", "x.start", "x.stop", "x.sentence")


def targeted_sentiment(found: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """(item_id, entity_id, sentence, label, score): clear sentiments of the sentences of mentions, once each."""
    once = found.select("item_id", "entity_id", "sentence").where("sentence is not null").dropDuplicates()
    scored = once.withColumn("s", sentiment(F.col("sentence"), positive, negative))
    clear = scored.where("s.label in ('positive', 'negative') and abs(s.positive - s.negative) >= 0.25 and s.confidence >= 0.45")
    return clear.select("item_id", "entity_id", "sentence", F.col("s.label").alias("label"), (F.col("s.positive") - F.col("s.negative")).alias("score"))


def event_candidates(items: DataFrame, found: DataFrame, triggers: dict[str, list[str]], least: dict[str, float] | None = None) -> DataFrame:
    """(item_id, event_type, place_id, confidence): sentences with a place and a trigger; the best per type and place.

    ``found``: mentions with item_id, entity_id, sentence, start and is_place.
    """
    places = found.where("is_place and sentence is not null").groupBy("item_id", "sentence").agg(F.min_by("entity_id", "start").alias("place_id"))
    actors = found.where("not is_place and sentence is not null").select("item_id", "sentence").distinct().withColumn("actor", F.lit(0.1))
    here = places.join(actors, ["item_id", "sentence"], "left").join(items.select("item_id", F.coalesce("title", F.lit("")).alias("title")), "item_id")
    here = here.withColumns({"in_text": class_hits(F.col("sentence"), triggers), "in_title": class_hits(F.col("title"), triggers)})
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("in_text")[n] > 0).alias("hit"), F.when(F.col("in_title")[n] > 0, 0.2).otherwise(0.0).alias("head"), F.lit((least or {}).get(k, 0.0)).alias("least")) for n, k in enumerate(triggers)])
    hit = here.select("item_id", "place_id", F.coalesce("actor", F.lit(0.0)).alias("actor"), F.explode(kinds).alias("k")).where("k.hit")
    sure = F.least(F.lit(0.85), 0.5 + F.col("k.head") + F.col("actor"))
    return hit.where(sure >= F.col("k.least")).groupBy("item_id", F.col("k.kind").alias("event_type"), "place_id").agg(F.max(sure).alias("confidence"))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("item_id")
    events: list[list] = []  # day, items, sources, best confidence, first item
    for item, day, source, sure in zip(pdf["item_id"], pdf["day"], pdf["source_id"], pdf["confidence"]):
        fits = [e for e in events if pd.Timedelta(0) <= pd.Timestamp(day) - pd.Timestamp(e[0]) <= pd.Timedelta(days=1)]
        if fits:
            e = min(fits, key=lambda e: e[0])
        else:
            e = [day, 0, set(), 0.0, item]
            events.append(e)
        e[1] += 1
        e[2].add(source)
        e[3] = max(e[3], sure)
    rows = [(pdf["event_type"].iloc[0], pdf["place_id"].iloc[0], e[0], e[4], e[1], len(e[2]), min(0.95, e[3] + 0.03 * (len(e[2]) - 1))) for e in events]
    return pd.DataFrame(rows, columns=["event_type", "place_id", "day", "first_item", "items", "sources", "confidence"])


def merge_events(candidates: DataFrame) -> DataFrame:
    """Events of one type and place on neighbouring days, in order of items (A-E1).

    ``candidates``: item_id, event_type, place_id, day, source_id, confidence.  Days more than one apart can't share an
    event, so each unbroken run of days of a (type, place) is a group of its own.
    """
    rows = candidates.select(F.col("item_id").cast("long").alias("item_id"), "event_type", F.col("place_id").cast("long").alias("place_id"), "day", F.col("source_id").cast("long").alias("source_id"), F.col("confidence").cast("double").alias("confidence"))
    key = ["event_type", "place_id"]
    w = Window.partitionBy(*key).orderBy("day")  # over distinct days only
    days = rows.select(*key, "day").distinct().withColumn("gap", F.when(F.datediff("day", F.lag("day").over(w)) > 1, 1).otherwise(0))
    runs = days.select(*key, "day", F.sum("gap").over(w).alias("run"))
    return rows.join(runs, [*key, "day"]).groupBy(*key, "run").applyInPandas(_merge, "event_type string, place_id long, day date, first_item long, items int, sources int, confidence double")
