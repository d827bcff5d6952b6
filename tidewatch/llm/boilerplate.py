"""Problem 3: lines that one source repeats too often.

Every partition parses its lines into a token tree of fixed depth: the first tokens, with a wildcard slot for every
token that holds a digit, lead to a leaf of templates.  A template counts each row once.  Trees are passed on as
(source, template, rows) whenever they have grown to ``tree_size`` templates, so memory is bounded, and the trees of
all partitions are merged by adding up: a source that holds a third of all rows arrives as a few counts per task.
A template is identified by its letters and signs alone: variants in case, digits, white space or invisible
characters, even where they move token borders, are merged in the same sum.

Defined results: null and empty texts have no lines but their rows count for the source; lines without anything but
digits, white space and invisible characters are no templates; rows without source form one source of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.session import cut

_INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁯﻿"
_SPACE = re.compile(rf"[{_INVISIBLE}]+")
_SLOT = re.compile(r"\d+")
WILD = "<*>"


def fold(line: str) -> str:
    """The line without differences of case; Turkish and German upper case included."""
    return line if line.isascii() and line.islower() else line.upper().casefold().replace("̇", "")


class TemplateTree:
    """A token tree of fixed depth with wildcard slots; its leaves count rows by template."""

    def __init__(self, depth: int = 3):
        self.depth, self.root, self.size = depth, {}, 0

    def add(self, source: int, line: str) -> str | None:
        """Counts one row for the line's template; None if the line has no template."""
        signature = self.signature(line)
        if signature:
            leaf = self.leaf(source, signature[1])
            self.size += signature[0] not in leaf
            leaf[signature[0]] = leaf.get(signature[0], 0) + 1
        return signature and signature[0]

    def leaf(self, source: int, tokens: list[str]) -> dict[str, int]:
        node = self.root.setdefault(source, {})
        for token in tokens:
            node = node.setdefault(token, {})
        return node.setdefault("", {})

    def signature(self, line: str) -> tuple[str, list[str]] | None:
        """The template's own letters and signs, and its path."""
        tokens = fold(_SPACE.sub("", line)).split()
        letters = _SLOT.sub("", "".join(tokens))
        if not letters:
            return None
        return letters, [WILD if _SLOT.search(t) else t for t in tokens[: self.depth]]

    def drain(self) -> Iterator[tuple[int, str, int]]:
        """All (source, template, rows); the tree is empty after."""

        def walk(node: dict) -> Iterator[tuple[str, int]]:
            for key, below in node.items():
                if key == "":
                    yield from below.items()
                else:
                    yield from walk(below)

        for source, node in self.root.items():
            for template, rows in walk(node):
                yield source, template, rows
        self.root, self.size = {}, 0


def _print(template: str) -> bytes:
    return xxhash.xxh3_128_digest(template)


def _grow(depth: int, tree_size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TemplateTree(depth)

        def out() -> pd.DataFrame:
            rows = [(s, _print(t), n) for s, t, n in tree.drain()]
            return pd.DataFrame(rows, columns=["source", "template", "rows"])

        for b in batches:
            for source, text in zip(b["source"], b["text"]):
                lines, seen = text.split("\n"), set()
                for line in lines:
                    sig = tree.signature(line)
                    if sig and sig[0] not in seen:  # a row counts once
                        seen.add(sig[0])
                        leaf = tree.leaf(source, sig[1])
                        tree.size += sig[0] not in leaf
                        leaf[sig[0]] = leaf.get(sig[0], 0) + 1
            if tree.size >= tree_size:
                yield out()
        yield out()

    return run


def _lines(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TemplateTree(depth)
        for b in batches:
            rows = []
            for row, source, text in zip(b["row_id"], b["source"], b["text"]):
                for n, line in enumerate(text.split("\n"), 1):
                    sig = tree.signature(line)
                    if sig:
                        rows.append((row, n, source, _print(sig[0])))
            yield pd.DataFrame(rows, columns=["row_id", "line_no", "source", "template"])

    return run


def repeated_lines(rows: DataFrame, least_rows: int = 8, least_share: float = 0.05, depth: int = 3, tree_size: int = 200_000) -> DataFrame:
    """(row_id, line_no) of every line whose template stands in too many rows of its source.

    ``rows``: row_id (unique), source_id, text.
    """
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.coalesce(F.col("source_id").cast("long"), F.lit(-1)).alias("source"), "text")
    texts = rows.where(F.col("text").isNotNull() & (F.col("text") != ""))
    counts = texts.select("source", "text").mapInPandas(_grow(depth, tree_size), "source long, template binary, rows long")
    of_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("all_rows"))
    # The sum is held against the absolute bound first, which leaves few rows to look up their source's size.
    often = counts.groupBy("source", "template").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= least_rows)
    cases = often.join(of_source, "source").where(F.col("rows") >= F.lit(least_share) * F.col("all_rows")).select("source", "template")
    lines = texts.mapInPandas(_lines(depth), "row_id long, line_no int, source long, template binary")
    return lines.join(cases, ["source", "template"]).select("row_id", "line_no")


def _masked(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TemplateTree(depth)
        for b in batches:
            rows = []
            for row, source, names, text, batch in zip(b["row_id"], b["source"], b["names"], b["text"], b["batch"]):
                own = sorted((s[0] for x in names if x and (s := tree.signature(x))), key=len, reverse=True) if names is not None else []
                for n, line in enumerate(text.split("\n"), 1):
                    if not (sig := tree.signature(line)):
                        continue
                    letters = "#" if all(w.startswith("#") for w in line.split()) else sig[0]
                    for name in own:
                        letters = letters.replace(name, WILD)
                    rows.append((row, n, source, _print(letters), batch))
            yield pd.DataFrame(rows, columns=["row_id", "line_no", "source", "template", "batch"])

    return run


def shared_lines(rows: DataFrame, least_rows: int = 8, least_sources: int = 4, depth: int = 3) -> DataFrame:
    """(row_id, line_no) of every line that many sources use, apart from their own names in it; tags alone are one line.

    ``rows``: row_id (unique), source_id, names (array of the source's names), text, batch.  A line is known as shared from
    the batch on with which it reaches both bounds: later batches change nothing about earlier ones.
    """
    asked = rows.select(F.col("row_id").cast("long").alias("row_id"), F.coalesce(F.col("source_id").cast("long"), F.lit(-1)).alias("source"), "names", "text", F.col("batch").cast("int").alias("batch"))
    lines = cut(asked.where(F.col("text").isNotNull()).mapInPandas(_masked(depth), "row_id long, line_no int, source long, template binary, batch int"))
    used = lines.groupBy("template", "source", "batch").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min("batch").over(Window.partitionBy("template", "source"))
    per_batch = used.withColumn("first", first).groupBy("template", "batch").agg(F.sum("rows").alias("rows"), F.count_if(F.col("first") == F.col("batch")).alias("sources"))
    so_far = Window.partitionBy("template").orderBy("batch")
    known = per_batch.select("template", "batch", F.sum("rows").over(so_far).alias("rows"), F.sum("sources").over(so_far).alias("sources"))
    since = known.where((F.col("rows") >= least_rows) & (F.col("sources") >= least_sources)).groupBy("template").agg(F.min("batch").alias("since"))
    return lines.join(since, "template").where("batch >= since").select("row_id", "line_no")


def without_repeated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (row_id, text and others) with every text without its found lines; rows without text stay as they are."""
    marked = found.groupBy("row_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("drop", (i + 1).cast("int")))
    joined = rows.withColumn("row_id", F.col("row_id").cast("long")).join(marked, "row_id", "left")
    return joined.withColumn("text", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("drop")
