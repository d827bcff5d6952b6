"""Problem 1: attributes as known at event time.

The validity of a history row, as recorded by then, is a half-open interval of instants.  Each interval is cut into
dyadic nodes of days (a node of level L covers 2**L days); an event looks up the node of every level that encloses
its day.  So the range join becomes an equi-join on (entity, level, node), and an exact half-open test keeps the
matches.  Intervals and events of one entity are spread over ``salts`` keys, for entities that hold a large part of
all events.

Defined results: events or history rows without entity or instant match nothing; an interval that ends before it
starts is empty; of several matches the latest recorded wins, then the highest row id; repeated rows are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Days from 1970 that nodes cover: 2**16 days reach the year 2149; other days are clamped to the ends.
LEVELS = 16
_LAST = (1 << LEVELS) - 1
_DAY = 86_400_000_000


def dyadic_cover(first: int, last: int) -> list[tuple[int, int]]:
    """(level, node) of the fewest dyadic nodes that make up the days first..last."""
    out, level = [], 0
    last += 1
    while first < last:
        if first & 1:
            out.append((level, first))
            first += 1
        if last & 1:
            last -= 1
            out.append((level, last))
        first, last, level = first >> 1, last >> 1, level + 1
    return out


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(nodes=[[level << (LEVELS + 1) | node for level, node in dyadic_cover(x, y)] for x, y in zip(b["first_day"], b["last_day"])])


def _day(us: Column) -> Column:
    return F.least(F.greatest(F.floor(us / F.lit(_DAY)), F.lit(0)), F.lit(_LAST)).cast("int")


def as_known(events: DataFrame, history: DataFrame, salts: int = 4) -> DataFrame:
    """(event_id, version_id): for each event the version that held at its instant, as recorded by then.

    ``events``: event_id, entity_id, instant_us.  ``history``: version_id, entity_id, start_us, end_us (null: open),
    recorded_us (precedence).
    """
    spans = history.where(F.col("entity_id").isNotNull() & F.col("start_us").isNotNull() & (F.col("end_us").isNull() | (F.col("end_us") > F.col("start_us"))))
    spans = spans.select(
        "version_id", "entity_id", "start_us", "end_us", "recorded_us",
        _day(F.col("start_us")).alias("first_day"), F.when(F.col("end_us").isNull(), F.lit(_LAST)).otherwise(_day(F.col("end_us") - 1)).alias("last_day"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", nodes array<int>"
    nodes = spans.mapInPandas(_cover, schema).drop("first_day", "last_day")
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("node", F.explode("nodes")).drop("nodes")

    day = _day(F.col("instant_us"))
    enclosing = F.expr(f"transform(sequence(0, {LEVELS}), l -> shiftleft(l, {LEVELS + 1}) | shiftright(day, l))")
    asked = (
        events.where(F.col("instant_us").isNotNull() & F.col("entity_id").isNotNull())
        .select("event_id", "entity_id", "instant_us", day.alias("day"), (F.pmod(F.xxhash64("event_id"), F.lit(salts))).cast("int").alias("salt"))
        .withColumn("node", F.explode(enclosing))
        .drop("day")
    )
    met = asked.join(nodes, ["entity_id", "node", "salt"]).where((F.col("start_us") <= F.col("instant_us")) & (F.col("end_us").isNull() | (F.col("instant_us") < F.col("end_us"))))
    best = F.max(F.struct("recorded_us", "version_id"))
    return met.groupBy("event_id").agg(best.alias("best")).select("event_id", F.col("best.version_id").alias("version_id"))
