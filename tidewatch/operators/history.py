"""Problem 5: a history of changing attributes from periodic snapshots.

Snapshot rows are range-partitioned and sorted by entity and time (Spark's sort merges the sorted runs of all
deliveries), then each partition is read once as a stream: of the rows of one snapshot date the last loaded holds, and
only changes of the payload are passed on, with the date of the last row seen.  An entity that holds a third of all
rows spreads over several ranges.  The changes, far fewer than the rows, are merged the same way by entity, which
closes versions that cross a range boundary.  Nothing but the current version is kept in memory.

Defined results: rows without entity or date are ignored; rows loaded at the same moment are ordered by their values;
null or blank labels are ``unknown``; null, blank or unreadable dimensions are one value of their own, ``{}`` another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

GONE = "\x00"  # payload of an entity that is present but belongs to no version
_RUN = "entity_id long, from_day string, payload string, label string"


def canonical_label(label: Column) -> Column:
    """Lower case without outer white space; null and blank are ``unknown``."""
    bare = F.lower(F.regexp_replace(label, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("unknown")).otherwise(bare)


def canonical_numbers(document: Column) -> Column:
    """A JSON object of numbers as one text, whatever its key order and number writing."""
    pairs = F.map_entries(F.from_json(document, "map<string,double>"))
    tidy = F.transform(pairs, lambda p: F.struct(F.trim(p["key"]).alias("key"), (p["value"] + F.lit(0.0)).alias("value")))
    return F.coalesce(F.to_json(F.array_sort(tidy)), F.lit(""))


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by entity and date to the rows at which the payload changes; the last row of a date counts."""
    held, last = None, (None, None)
    for b in batches:
        out = []
        for row in zip(b["entity_id"], b["from_day"], b["payload"], b["label"]):
            if held is not None and row[:2] != held[:2]:
                if (held[0], held[2]) != last:
                    out.append(held)
                    last = (held[0], held[2])
            held = row
        if out:
            yield pd.DataFrame(out, columns=["entity_id", "from_day", "payload", "label"])
    if held is not None and (held[0], held[2]) != last:
        yield pd.DataFrame([held], columns=["entity_id", "from_day", "payload", "label"])


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes sorted by entity and date to closed versions."""
    names = ["entity_id", "valid_from", "valid_to", "label", "payload"]
    now = None  # the open version
    for b in batches:
        out = []
        for entity, day, payload, label in zip(b["entity_id"], b["from_day"], b["payload"], b["label"]):
            if now is not None and now[0] == entity and now[3] == payload:
                continue
            if now is not None and now[3] != GONE:
                out.append((now[0], now[1], day if now[0] == entity else "", now[2], now[3]))
            now = (entity, day, label, payload)
        yield pd.DataFrame(out, columns=names)
    if now is not None and now[3] != GONE:
        yield pd.DataFrame([(now[0], now[1], "", now[2], now[3])], columns=names)


def build_history(snapshots: DataFrame) -> DataFrame:
    """(entity_id, valid_from, valid_to, label, payload) from (entity_id, day, loaded_at, label, payload).

    ``payload`` decides what a change is; GONE belongs to no version.  ``valid_to`` is '' while open.
    """
    rows = snapshots.where(F.col("entity_id").isNotNull() & F.col("day").isNotNull()).select(
        F.col("entity_id").cast("long").alias("entity_id"), F.date_format("day", "yyyy-MM-dd").alias("from_day"), "payload", "label", "loaded_at"
    )
    key = ["entity_id", "from_day"]
    sorted_rows = rows.repartitionByRange(*key).sortWithinPartitions(*key, "loaded_at", "payload").drop("loaded_at")
    changes = sorted_rows.mapInPandas(_changes, _RUN)
    merged = changes.repartition("entity_id").sortWithinPartitions(*key)
    return merged.mapInPandas(_close, "entity_id long, valid_from string, valid_to string, label string, payload string")
