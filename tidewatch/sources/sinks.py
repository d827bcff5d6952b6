"""Writing: upserts, versions, histories, exports (K1-K9).  Targets are Parquet tables that are rewritten or appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def classify_upsert(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Stored and incoming rows by key with ``action``: insert, update, unchanged or kept (K1).

    Of several incoming rows of one key the one with the greatest content hash order counts, so results don't depend on
    the order of arrival.
    """
    new = incoming.groupBy(key).agg(F.max(F.struct(content, *[c for c in incoming.columns if c not in (key, content)])).alias("new"))
    old = stored.select(key, F.struct(*[c for c in stored.columns if c != key]).alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "kept").when(F.col(f"new.{content}").eqNullSafe(F.col(f"old.{content}")), "unchanged").otherwise("update")
    return old.join(new, key, "full").withColumn("action", action)


def apply_upsert(classified: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after the upsert, and the versions that were replaced."""
    fresh = F.col("action").isin("insert", "update")
    after = classified.select(key, *[F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns])
    return after, classified.where("action = 'update'").select(key, "old.*")


def overwrite_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replaces the days that ``df`` holds and leaves the others (K2); repeating it changes nothing."""
    df.repartition(day).sortWithinPartitions(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def mark_current(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """``is_current`` for the row of the highest version of each key (K3)."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return rows.withColumn("is_current", F.row_number().over(w) == 1)


def close_and_open(history: DataFrame, today: DataFrame, key: str, payload: list[str], day: Column, evidence: list[str] = ()) -> DataFrame:
    """History with today's values (K4): equal payload keeps the open row, another one closes it and opens a new row.

    ``history``: key, payload, evidence, valid_from, valid_to (null: open).  Where the payload is equal, today's evidence
    replaces the open row's in place.  Where evidence is named and today's has none, the payload is ``unknown``.  Keys missing
    today stay as they are.
    """
    if evidence:
        bare = F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.lit(True)) for c in evidence], F.lit(False))
        today = today.withColumns({c: F.when(bare, F.col(c)).otherwise("unknown") for c in payload})
    columns = [*payload, *evidence]
    closed = history.where("valid_to is not null")
    pair = lambda df, name: df.select(key, F.struct(*payload).alias(name), F.struct(*columns).alias(f"{name}_row"), *([c for c in ("valid_from",) if c in df.columns]))
    joined = pair(history.where("valid_to is null"), "old").join(pair(today.select(key, *columns), "new"), key, "full")
    same = F.coalesce(F.col("new").eqNullSafe(F.col("old")), F.lit(False))
    row = F.when(same, F.col("new_row")).otherwise(F.col("old_row")).alias("row")
    kept = joined.where(F.col("old").isNotNull()).select(key, row, "valid_from", F.when(same | F.col("new").isNull(), F.lit(None)).otherwise(day).cast("date").alias("valid_to"))
    opened = joined.where(F.col("new").isNotNull() & ~same).select(key, F.col("new_row").alias("row"), day.cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    both = kept.unionByName(opened).select(key, "row.*", "valid_from", "valid_to")
    return closed.select(*both.columns).unionByName(both)


def archive_missing(stored: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Stored rows with status archived where the registry has them no more (K5)."""
    there = registry.select(key).distinct().withColumn("there", F.lit(True))
    return stored.join(there, key, "left").withColumn("status", F.when(F.col("there"), "curated").otherwise("archived")).drop("there")


def guard_formula(c: Column) -> Column:
    """Text that a spreadsheet would run gets an apostrophe in front (K6)."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    guarded = df.select(*[guard_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    # Spreadsheets take a file for UTF-8 by the mark at its beginning.
    marked = guarded.withColumnRenamed(guarded.columns[0], f"\ufeff{guarded.columns[0]}") if guarded.columns else guarded
    marked.write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")


def as_json(df: DataFrame, filters: str, demo: bool) -> DataFrame:
    """One JSON text per row, with the filters it was made under (K7)."""
    return df.select(F.to_json(F.struct(F.struct(*df.columns).alias("item"), F.lit(filters).alias("filters"), F.lit(demo).alias("contains_demo_data")), {"ignoreNullFields": "false"}).alias("value"))


def citation_key(source: Column, day: Column, title: Column, item_id: Column) -> Column:
    """Source, year, first word of the headline and id (K8)."""
    word = F.substring(F.regexp_replace(F.element_at(F.split(F.trim(F.when(F.coalesce(title, F.lit("")) == "", "x").otherwise(title)), r"\s+"), 1), r"(?U)\W+", ""), 1, 12)
    outlet = F.substring(F.regexp_replace(F.lower(source), "[^a-z0-9]", ""), 1, 15)
    return F.concat(outlet, F.coalesce(F.date_format(day, "yyyy"), F.lit("")), F.when(word == "", "item").otherwise(word), item_id.cast("string"))


DEMO_NOTE = "DEMO DATA (synthetic record)"


def bibtex(key: Column, row: dict[str, Column], seen: Column, note: str) -> Column:
    """A BibTeX entry (K8).  ``row``: title, source, day, url, language, is_demo; ``seen``: the day of the export."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    date = lambda c, form: F.coalesce(F.date_format(c, form), F.lit(""))
    fields = {
        "title": safe(row["title"]), "howpublished": safe(row["source"]), "year": date(row["day"], "yyyy"), "date": date(row["day"], "yyyy-MM-dd"), "url": F.coalesce(row["url"], F.lit("")),
        "language": F.coalesce(row["language"], F.lit("")), "urldate": date(seen, "yyyy-MM-dd"), "note": F.when(F.coalesce(row["is_demo"], F.lit(False)), DEMO_NOTE).otherwise(note),
    }
    lines = [F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")) for name, value in fields.items()]
    return F.concat(F.lit("@misc{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def ris(row: dict[str, Column], seen: Column) -> Column:
    """A RIS record (K8).  ``row`` as for ``bibtex``, and excerpt."""
    text = lambda c: F.coalesce(c, F.lit(""))
    tags = [("TY", F.lit("NEWS")), ("TI", text(row["title"])), ("T2", text(row["source"])), ("PY", text(F.date_format(row["day"], "yyyy"))), ("DA", text(F.date_format(row["day"], "yyyy/MM/dd"))), ("UR", text(row["url"])), ("LA", text(row["language"])), ("Y2", text(F.date_format(seen, "yyyy-MM-dd")))]
    tags += [("AB", F.when(row["excerpt"] != "", row["excerpt"])), ("N1", F.when(row["is_demo"], DEMO_NOTE)), ("ER", F.lit(""))]
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{tag}  - "), value) for tag, value in tags])), "\n")


def markdown_row(*cells: Column) -> Column:
    """A row of a Markdown table (K9)."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in cells]), F.lit(" |"))
