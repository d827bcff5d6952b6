"""Queries of the corpus operators over the data folder's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.batches import duplicates
from tidewatch.llm.boilerplate import repeated_lines, shared_lines, without_repeated
from tidewatch.llm.forms import look_alike_pairs, normalise
from tidewatch.llm.languages import fit_on, label_code, languages_of, mislabelled, segments_of
from tidewatch.llm.leaks import find_leaks
from tidewatch.llm.mixing import mix, reached_shares
from tidewatch.llm.names import group_unknown, link_names
from tidewatch.session import cut
from tidewatch.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each article of a later batch the first accepted article with the same report, if there is one.

    The accepted history comes first and then one batch after the other, each against what was accepted before it.
    Lines that many sources have shared by then are left out of the comparison.
    """
    articles = table(spark, folder, "articles").withColumn("batch", F.coalesce("batch_no", F.lit(0)).cast("int"))
    names = table(spark, folder, "sources").groupBy("source_id").agg(F.array_union(F.collect_set("name"), F.collect_set("name_native")).alias("names"))
    rows = articles.select(F.col("article_id").alias("row_id"), "source_id", F.col("excerpt").alias("text"), "batch", "url", "title")
    bare = without_repeated(rows.withColumn("excerpt", F.col("text")), shared_lines(rows.join(names, "source_id", "left")))
    # A text of nothing but shared lines is compared as it is.
    text = F.when(F.trim("text") == "", F.col("excerpt")).otherwise(F.col("text"))
    records = bare.select(F.col("row_id").alias("id"), "batch", "url", "title", text.alias("text"))
    found = duplicates(records).join(articles.where("batch >= 1").select(F.col("article_id").alias("id")), "id", "left_semi")
    return found.select(F.col("first").alias("kept_id"), F.col("id").alias("article_id"))


_ASCII = r"^[\x00-\x7F]*$"
LINED = (("raw_items", "item_id", "summary"), ("articles", "article_id", "excerpt"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of summaries and excerpts that one source repeats too often."""
    parts = []
    for name, key, text in LINED:
        rows = table(spark, folder, name).select(F.col(key).alias("row_id"), "source_id", F.col(text).alias("text"))
        parts.append(repeated_lines(rows).select(F.lit(name).alias("table_name"), "row_id", "line_no"))
    return parts[0].unionByName(parts[1]).distinct()


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every summary and excerpt without those lines."""
    parts = []
    for name, key, text in LINED:
        rows = table(spark, folder, name).select(F.col(key).alias("row_id"), "source_id", F.col(text).alias("text"))
        parts.append(without_repeated(rows, repeated_lines(rows)).select(F.lit(name).alias("table_name"), "row_id", "text"))
    return parts[0].unionByName(parts[1])


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of all three tables with the labels they were delivered with."""
    rows = [
        table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("row_id"), F.col(label).alias("label"), F.concat_ws("\n", *texts).alias("text"))
        for name, key, label, texts in (("articles", "article_id", "language", ["title", "excerpt"]), ("raw_items", "item_id", "language_hint", ["title", "summary"]), ("documents", "doc_id", "lang", ["text"]))
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's languages with a confidence, against its label."""
    model = fit_on(table(spark, folder, "documents").select("text", label_code(F.col("lang")).alias("code")))
    return languages_of(_labelled(spark, folder), model)


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of every text that are written in one language, with a confidence."""
    model = fit_on(table(spark, folder, "documents").select("text", label_code(F.col("lang")).alias("code")))
    return segments_of(_labelled(spark, folder), model)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of the texts whose label is missing, meaningless or wrong, or that mix languages."""
    return mislabelled(p4_languages(spark, folder)).select("table_name", "row_id", "language").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entity that each unlinked mention names."""
    kinds = table(spark, folder, "entities").select("entity_id", (F.col("entity_type") != "person").alias("is_org"), "name_en", "name_ar")
    names = kinds.select("entity_id", "is_org", F.explode(F.array("name_en", "name_ar")).alias("form"))
    aliases = table(spark, folder, "entity_aliases").select("entity_id", F.col("surface_form").alias("form")).join(kinds.select("entity_id", "is_org"), "entity_id")
    mentions = table(spark, folder, "entity_mentions").where(F.col("entity_id").isNull()).select("mention_id", F.col("surface_form").alias("form"))
    linked = link_names(mentions.select("form"), names.unionByName(aliases.select("entity_id", "is_org", "form")))
    return mentions.join(linked, "form").select("mention_id", "entity_id").distinct()


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The unlinked mentions that name no listed entity, with the spelling that stands for each group of variants."""
    linked = p7_found(spark, folder).select("mention_id")
    rest = table(spark, folder, "entity_mentions").where(F.col("entity_id").isNull()).select("mention_id", F.col("surface_form").alias("form"), F.col("entity_type")).join(linked, "mention_id", "left_anti")
    return rest.join(group_unknown(rest.select("form")), "form").select("mention_id", "form", "group")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of an item in a document, near ones included, with its similarity."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an item."""
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.where("exact").select("doc_id", "item_id").distinct()


def p8_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The same for documents and items of plain ASCII, which SQL can cut into words as well; the operator gets all of them."""
    plain = F.col("text").rlike(_ASCII)
    docs = table(spark, folder, "documents").where(plain).select(F.col("doc_id").cast("long").alias("doc_id"))
    items = table(spark, folder, "eval_items").where(plain).select("item_id")
    return p8_found(spark, folder).join(docs, "doc_id", "left_semi").join(items, "item_id", "left_semi").select("doc_id", "item_id")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used so that the sources reach their target shares of all tokens."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).drop("weights")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that this selection reaches."""
    targets = table(spark, folder, "mix_targets")
    return reached_shares(mix(table(spark, folder, "documents"), targets), targets)


def p9_soft_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares where documents of other sources take part as well, by what the classifier makes of their texts."""
    targets = table(spark, folder, "mix_targets")
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    named = docs.join(F.broadcast(targets.select("source").distinct().withColumn("known", F.lit(True))), "source", "left")
    return reached_shares(mix(named.withColumn("source", F.when(F.col("known"), F.col("source"))).drop("known"), targets), targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose texts look the same but differ in characters."""
    return look_alike_pairs(table(spark, folder, "documents"))


def p10_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in the one form for comparisons."""
    return normalise(table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_cleaned": p3_cleaned, "p4_found": p4_found, "p4_languages": p4_languages, "p4_segments": p4_segments,
    "p7_found": p7_found, "p7_groups": p7_groups, "p8_near": p8_near, "p8_plain": p8_plain, "p8_found": p8_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_soft_shares": p9_soft_shares,
    "p10_found": p10_found, "p10_normalised": p10_normalised,
}

_LINES = "select '{0}' as table_name, cast({1} as bigint) as row_id, coalesce(source_id, -1) as source_id, {2} as body from {0}"
_GRAMS = r"(select {1}, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) as g from (select {1}, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from {0} where regexp_matches(text, '^[\x00-\x7F]*$')))"
ORACLES: dict[str, str] = {
    "p8_plain": f"select distinct cast(d.doc_id as bigint) as doc_id, i.item_id from {_GRAMS.format('documents', 'doc_id')} d join {_GRAMS.format('eval_items', 'item_id')} i using (g)",
    "p3_found": r"""
with r as (RAW union all ARTICLES),
size as (select table_name, source_id, count(*) as n from r group by 1, 2),
split as (select table_name, row_id, source_id, string_split(body, chr(10)) as ls from r where body is not null and body <> ''),
l as (select table_name, row_id, source_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as line_no from split),
k as (select table_name, row_id, source_id, cast(line_no as int) as line_no,
        regexp_replace(lower(upper(replace(replace(replace(line, 'ß', 'ss'), 'İ', 'i'), 'ı', 'i'))), '[\s\p{Z}\p{Cf}\p{Nd}]+', '', 'g') as key from l),
o as (select table_name, source_id, key, count(distinct row_id) as m from k where key <> '' group by 1, 2, 3)
select k.table_name, k.row_id, k.line_no from k join o using (table_name, source_id, key) join size using (table_name, source_id)
where m >= 8 and m >= 0.05 * n""".replace("RAW", _LINES.format("raw_items", "item_id", "summary")).replace("ARTICLES", _LINES.format("articles", "article_id", "excerpt")),
}
