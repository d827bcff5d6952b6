"""The standard filter of items and sources (F1-F8), as one value object."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import cut

MOST_DAYS, DEFAULT_DAYS = 366, 30
SOURCE_ATTRIBUTES = ("country", "source_type", "source_group", "operating_base", "category", "tier", "coverage_area", "slug", "domain", "time_zone")


def split_values(*values: str) -> list[str]:
    """Comma lists and repeats to one list without blanks."""
    return [p for v in values for x in v.split(",") if (p := x.strip())]


@dataclass(frozen=True)
class ItemFilter:
    """Which items count: a half-open range of days, and conjunctions of attributes."""

    start: date | None = None
    end: date | None = None  # exclusive
    languages: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    entities: tuple[int, ...] = ()
    demo: str = "exclude"  # include, exclude or only
    copies: bool = True  # whether syndicated copies count
    sources: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def parse(today: date, start: str = "", end: str = "", languages: str = "", demo: str = "exclude", **sources: str) -> ItemFilter:
        """From request values: the last 30 days by default, 366 at most."""
        last = date.fromisoformat(end) if end else today
        first = date.fromisoformat(start) if start else last - timedelta(days=DEFAULT_DAYS - 1)
        if first > last:
            raise ValueError("the range ends before it starts")
        if (last - first).days >= MOST_DAYS:
            raise ValueError(f"the range is longer than {MOST_DAYS} days")
        if demo not in ("include", "exclude", "only"):
            raise ValueError("demo is include, exclude or only")
        unknown = set(sources) - set(SOURCE_ATTRIBUTES)
        if unknown:
            raise ValueError(f"unknown attributes: {sorted(unknown)}")
        chosen = {k: tuple(x.upper() if k in ("country", "tier") else x for x in split_values(v)) for k, v in sources.items()}
        return ItemFilter(first, last + timedelta(days=1), tuple(x.lower() for x in split_values(languages)), demo=demo, sources={k: v for k, v in chosen.items() if v})


def source_condition(chosen: dict[str, tuple[str, ...]]) -> Column:
    """One of the values of every attribute."""
    out = F.lit(True)
    for name, values in chosen.items():
        out = out & F.col(name).isin(*values)
    return out


def group_condition(include: dict[str, tuple[str, ...]], exclude: dict[str, tuple[str, ...]]) -> Column:
    """As ``source_condition``, without the excluded values; unknown values drop out of both, as in SQL."""
    out = source_condition(include)
    for name, values in exclude.items():
        out = out & ~F.col(name).isin(*values)
    return out


def any_group(conditions: list[Column]) -> Column:
    """Sources of any of the groups."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def status_or_demo(column: str, value: str) -> Column:
    """A registry status, or a demonstration source whatever its status (F8)."""
    return F.coalesce(F.col(column) == value, F.lit(False)) | F.coalesce("is_demo", F.lit(False))


def in_subtree(items: DataFrame, tree: DataFrame, root: str, column: str = "primary_category") -> DataFrame:
    """Items of a category or of any below it (F4).  ``tree``: category, parent; as deep as it is, cycles included."""
    edges = tree.where("parent is not null").select("category", "parent").distinct()
    below = now = tree.sparkSession.createDataFrame([(root,)], "category string")
    while True:
        now = edges.join(now.withColumnRenamed("category", "parent"), "parent", "left_semi").select("category").distinct().join(below, "category", "left_anti")
        now = cut(now)
        if now.isEmpty():
            return items.join(below.withColumnRenamed("category", column), column, "left_semi")
        below = below.unionByName(now)


def apply_filter(items: DataFrame, sources: DataFrame, f: ItemFilter, mentions: DataFrame | None = None) -> DataFrame:
    """The items that count: day conditions reach the scan, attributes are semi-joins."""
    out = items
    if f.start is not None:
        out = out.where(F.col("fetched_at") >= F.lit(str(f.start)).cast("timestamp"))
    if f.end is not None:
        out = out.where(F.col("fetched_at") < F.lit(str(f.end)).cast("timestamp"))
    if f.languages:
        out = out.where(F.col("language").isin(*f.languages))
    if f.categories:
        out = out.where(F.col("primary_category").isin(*f.categories))
    if f.demo != "include":
        out = out.where(F.coalesce("is_demo", F.lit(False)) == F.lit(f.demo == "only"))
    if not f.copies:
        out = out.where(~F.coalesce("is_syndicated", F.lit(False)))
    if f.sources:
        out = out.join(sources.where(source_condition(f.sources)).select("source_id"), "source_id", "left_semi")
    if f.entities and mentions is not None:
        out = out.join(mentions.where(F.col("entity_id").isin(*f.entities)).select("article_id"), "article_id", "left_semi")
    return out


AHEAD, RELEVANT, AGGREGATED = "interval 6 hours", 0.75, 0.6


def gate(items: DataFrame, look_back_days: int) -> DataFrame:
    """``items`` (published, now, aggregator, relevance) with decision, published_at, estimated and relevance.

    A date more than six hours ahead is now, an item older than the look-back is left out; so is one of little relevance,
    unless it comes from an aggregator, whose queries have chosen it: without any term it counts 0.6.  No date is now.
    """
    published = F.when(F.col("published") > F.col("now") + F.expr(AHEAD), F.col("now")).otherwise(F.col("published"))
    old = published < F.col("now") - F.make_interval(days=F.lit(look_back_days))
    decision = F.when(old, "old").when(~F.col("aggregator") & (F.col("relevance") < RELEVANT), "irrelevant").otherwise("kept")
    scored = F.when(F.col("aggregator") & (F.col("relevance") == 0), AGGREGATED).otherwise(F.col("relevance"))
    return items.withColumns({"decision": decision, "published_at": F.coalesce(published, F.col("now")), "estimated": F.col("published").isNull(), "relevance": scored})
