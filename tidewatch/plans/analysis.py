"""Dictionary-based analysis with a small vocabulary of our own (N2-N13), scalar functions over the tables (T*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scoring import completeness, relevance
from tidewatch.functions.stats import js_divergence
from tidewatch.functions.text import content_hash, dominant_script, excerpt, first_line, quoted_in, sentences, shingles, strip_html, word_count
from tidewatch.functions.urls import canonical_url, domain_of, url_hash
from tidewatch.functions.terms import class_hits
from tidewatch.operators.lexicon import category_scores, classify, event_candidates, evidence, frames, mentions, merge_events, model_label, sentiment, shares, targeted_sentiment
from tidewatch.plans.catalog import items, query
from tidewatch.tables import table

# A small vocabulary of our own; vocabularies are inputs of the operators.
POSITIVE = ["useful", "promise", "open", "reopen", "sign", "agree", "answered", "helpful", "stayed open", "delivery", "note", "signed", "witness"]
NEGATIVE = ["complaint", "dispute", "slow", "closed", "prohibited", "withdrawn", "late", "no date", "not yet", "left without", "rose by", "declined", "comment", "figure"]
EMOTIONS = {"hope": ["promise", "wait"], "anger": ["complaint", "dispute"], "calm": ["quietly", "useful"]}
TONES = {"factual": ["according to", "percent", "reported"], "critical": ["not yet", "complaint", "declined"], "formal": ["memo", "directorate", "council"]}
CUES = {"economy": ["price", "market permit", "percent"], "conflict": ["dispute", "closed", "declined"], "services": ["drinking water", "grid repair", "school book"]}
TERMS = [("water", "services", "drinking water"), ("power", "services", "grid repair"), ("power", "services", "diesel"), ("trade", "economy", "market permit"), ("trade", "economy", "price"), ("transport", "economy", "ferry ticket"), ("transport", "economy", "bridge toll")]
TRIGGERS = {"statement": ["declined", "quoted"], "agreement": ["signed"], "talks": ["talks", "met"]}

_ENDINGS = "s|es|''s|i|is|n|en|e|ite|ites|ien|iens|ienne|iennes|isch|ische|ischen"


def form_sql(column: str) -> str:
    """The matching form of Latin text."""
    return f"strip_accents(lower(coalesce({column}, '')))"


def hits_sql(column: str, terms: list[str]) -> str:
    """How many different terms stand in a text, by the rule of whole words with endings."""
    one = r"cast(regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_]){1}({2})?([^\p{{L}}\p{{N}}_]|$)') as int)"
    return "(" + " + ".join(one.format(form_sql(column), t.replace(" ", r"\s+"), _ENDINGS) for t in terms) + ")"


def sentiment_sql(p: str, n: str) -> str:
    """The columns of a sentiment from its hits, as the survey writes the formula."""
    t, up, down = f"({p} + {n})", f"(({p} + 0.5) / ({p} + {n} + 1))", f"(({n} + 0.5) / ({p} + {n} + 1))"
    pos, neg = (f"case when {t} = 0 then 0.1 else round({x} * least(1.0, {t} / 4.0), 4) end" for x in (up, down))
    sure = f"case when {t} = 0 then 0.4 else round(least(0.7, 0.35 + 0.1 * {t}) * (0.6 + 0.4 * abs({up} - {down})), 4) end"
    return f"{pos} as positive, {neg} as negative, {sure} as confidence"


_LABEL = """case when confidence < 0.35 then 'uncertain' when positive >= negative and positive >= neutral then 'positive' when negative >= neutral then 'negative' else 'neutral' end"""
_NEUTRAL = "case when positive = 0.1 and negative = 0.1 and confidence = 0.4 then 0.8 else round(greatest(1 - positive - negative, 0), 4) end"


def _texts(spark, folder):
    return items(spark, folder).select(F.col("article_id").alias("item_id"), "title", F.col("excerpt").alias("text"), "day", "source_id")


@query(
    "lexicon_sentiment",
    f"""with h as (select article_id as item_id, {hits_sql("excerpt", POSITIVE)}::double as p, {hits_sql("excerpt", NEGATIVE)}::double as n from {{items}} a),
    s as (select item_id, {sentiment_sql("p", "n")} from h), v as (select *, {_NEUTRAL} as neutral from s)
    select item_id, {_LABEL} as label, positive, negative, confidence from v""",
)
def lexicon_sentiment(spark, folder):
    """Sentiment by dictionary."""
    s = _texts(spark, folder).select("item_id", sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("s"))
    return s.select("item_id", "s.label", "s.positive", "s.negative", "s.confidence")


def _leading_sql(classes: dict[str, list[str]]) -> str:
    columns = ", ".join(f"{hits_sql('excerpt', ts)}::double as {c}" for c, ts in classes.items())
    names = list(classes)
    first = " ".join(f"when {c} = m then '{c}'" for c in names)
    return f"""with h as (select article_id as item_id, {columns} from {{items}} a), t as (select *, {' + '.join(names)} as t, greatest({', '.join(names)}) as m from h)
    select item_id, case when t = 0 then 'none' {first} end as label, case when t = 0 then 0.3 else round(least(0.65, 0.3 + 0.1 * t) * round(m / t, 4), 4) end as confidence from t"""


@query("lexicon_emotions", _leading_sql(EMOTIONS))
def lexicon_emotions(spark, folder):
    """The leading emotion of each item."""
    s = _texts(spark, folder).select("item_id", shares(F.col("text"), EMOTIONS).alias("s"))
    return s.select("item_id", "s.label", "s.confidence")


@query("lexicon_tones", _leading_sql(TONES))
def lexicon_tones(spark, folder):
    """The leading tone of each item."""
    s = _texts(spark, folder).select("item_id", shares(F.col("text"), TONES).alias("s"))
    return s.select("item_id", "s.label", "s.confidence")


@query(
    "emotion_evidence",
    f"""select article_id as item_id, array_to_string(list_filter([{', '.join(f"case when {hits_sql('excerpt', [t])} > 0 then '{t}' end" for ts in EMOTIONS.values() for t in ts)}], lambda x: x is not null), ', ') as words from {{items}} a""",
)
def emotion_evidence(spark, folder):
    """The words that an item's emotion rests on."""
    return _texts(spark, folder).select("item_id", F.array_join(evidence(F.col("text"), EMOTIONS), ", ").alias("words"))


@query("model_labels", "select mention_id, case lower('LABEL_' || (mention_id % 3)) when 'label_0' then 'negative' when 'label_1' then 'neutral' else 'positive' end as label from entity_mentions")
def model_labels(spark, folder):
    """Labels of a sentiment model in one notation (N9); ids stand for its answers."""
    return table(spark, folder, "entity_mentions").select("mention_id", model_label(F.concat(F.lit("LABEL_"), (F.col("mention_id") % 3).cast("string"))).alias("label"))


@query("frame_hits")
def frame_hits(spark, folder):
    """Frames with their evidence (N10); sentence splitting needs look-behind, so it is tested on a fixture."""
    return frames(_texts(spark, folder).where("text is not null"), CUES)


@query(
    "keyword_presence",
    f"""select article_id as item_id, {', '.join(f"{hits_sql('concat_ws({0} {0}, title, excerpt)'.format(chr(39)), ts)}::int as {c}" for c, ts in CUES.items())} from {{items}} a""",
)
def keyword_presence(spark, folder):
    """How many different cues of each frame an item holds."""
    counted = _texts(spark, folder).select("item_id", class_hits(F.concat_ws(" ", "title", "text"), CUES).alias("n"))
    return counted.select("item_id", *[F.col("n")[k].alias(c) for k, c in enumerate(CUES)])


@query("keyword_categories")
def keyword_categories(spark, folder):
    """Primary and secondary categories by terms (N2, N3, N5); occurrence counts are tested on a fixture."""
    terms = spark.createDataFrame(TERMS, "category string, parent string, term string")
    return classify(category_scores(_texts(spark, folder), terms))


def _found(spark, folder):
    aliases = table(spark, folder, "entity_aliases").where("use_match").select("alias_id", "entity_id", F.col("surface_form").alias("form"))
    return mentions(_texts(spark, folder), aliases)


@query("gazetteer_mentions")
def gazetteer_mentions(spark, folder):
    """Mentions of listed names, longest first (N11); greedy, tested against a plain loop."""
    return _found(spark, folder)


#: Clear sentiments of the sentences of linked mentions, once each, as rows of SQL.
TARGETED_SQL = f"""(select item_id, entity_id, sentence, {_LABEL} as label, round(positive - negative, 4) as score from
  (select *, {_NEUTRAL} as neutral from (select item_id, entity_id, sentence, {sentiment_sql("p", "n")} from
    (select distinct article_id as item_id, entity_id, sentence, {hits_sql("sentence", POSITIVE)}::double as p, {hits_sql("sentence", NEGATIVE)}::double as n from entity_mentions where entity_id is not null and sentence is not null)))
  where {_LABEL} in ('positive', 'negative') and abs(positive - negative) >= 0.25 and confidence >= 0.45)"""


def targeted_rows(spark, folder):
    """Clear sentiments of the sentences of linked mentions, once each."""
    m = table(spark, folder, "entity_mentions").where("entity_id is not null").select(F.col("article_id").alias("item_id"), "entity_id", "sentence")
    return targeted_sentiment(m, POSITIVE, NEGATIVE).withColumn("score", F.round("score", 4))


@query("targeted_sentiment", f"select * from {TARGETED_SQL} t")
def targeted(spark, folder):
    """Clear sentiments of the sentences that name an actor."""
    return targeted_rows(spark, folder)


@query("targeted_of_found")
def targeted_of_found(spark, folder):
    """The same of the mentions that the gazetteer finds itself."""
    return targeted_sentiment(_found(spark, folder), POSITIVE, NEGATIVE)


@query("event_merge")
def event_merge(spark, folder):
    """Reported events merged over neighbouring days (N13, A-E1).  Organisations stand for places."""
    kinds = table(spark, folder, "entities").select("entity_id", (F.col("entity_type") != "person").alias("is_place"))
    texts = _texts(spark, folder)
    found = _found(spark, folder).join(kinds, "entity_id")
    candidates = event_candidates(texts, found, TRIGGERS, {"talks": 0.5})
    return merge_events(candidates.join(texts.select("item_id", "day", "source_id"), "item_id"))


@query(
    "script_and_words",
    r"""with c as (select doc_id, len(regexp_extract_all(text, '\p{Arabic}')) as a, len(regexp_extract_all(text, '\p{Latin}')) as l, len(regexp_extract_all(text, '\p{Cyrillic}')) as y, len(regexp_extract_all(text, '\p{Han}')) as h,
    len(list_filter(regexp_split_to_array(text, '[\t\n\v\f\r ]+'), lambda x: x <> '')) as words from documents)
    select doc_id, case when greatest(a, l, y, h) = 0 then 'Zyyy' when a = greatest(a, l, y, h) then 'Arab' when l = greatest(a, l, y, h) then 'Latn' when y = greatest(a, l, y, h) then 'Cyrl' else 'Hani' end as script, words::int as words from c""",
)
def script_and_words(spark, folder):
    """Dominant script and number of words of every document."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", dominant_script(F.col("text")).alias("script"), word_count(F.col("text")).alias("words"))


_TRACKED_SQL = "^(fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src|cmpid|ocid|at_medium|at_campaign|xtor|smid|_ga|guccounter|output|amp|outputtype|rss|from|source|s_cid|utm_[0-9a-z_]+|at_custom[0-9]+|ns_[0-9a-z_]+)$"


@query(
    "canonical_urls",
    rf"""with u as (select article_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) as h, regexp_extract(url, '^[A-Za-z]+://[^/?#:]+:(\d+)', 1) as port, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) as p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q from articles),
    w as (select *, regexp_replace(regexp_replace(regexp_replace(case when p = '' then '/' else p end, '(/amp/?$|\.amp$|\.amp\.html$)', '/', 'gi'), '/amp/', '/', 'gi'), '//+', '/', 'g') as path0 from u),
    v as (select *, regexp_replace(regexp_replace(h, '^www\.', ''), '^m\.', '') as d, case when length(path0) > 1 then regexp_replace(path0, '/+$', '') else path0 end as path,
      list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]+=.')), lambda x: [url_decode(string_split(x, '=')[1]), url_decode(regexp_replace(x, '^[^=]*=', ''))]), lambda y: not regexp_matches(lower(y[1]), '{_TRACKED_SQL}'))) as ps from w)
    select article_id, d as domain, 'https://' || d || case when port in ('', '80', '443') then '' else ':' || port end || path || case when len(ps) = 0 then '' else '?' || array_to_string(list_transform(ps, lambda y: replace(url_encode(y[1]), '%20', '+') || '=' || replace(url_encode(y[2]), '%20', '+')), '&') end as canonical from v where d <> ''""",
)
def canonical_urls(spark, folder):
    """Addresses in one form."""
    a = table(spark, folder, "articles").select("article_id", domain_of(F.col("url")).alias("domain"), canonical_url(F.col("url")).alias("canonical"))
    return a.where("domain is not null")


@query("url_hashes", None)
def url_hashes(spark, folder):
    """Key of each address."""
    return table(spark, folder, "raw_items").select("item_id", url_hash(F.col("url")).alias("url_hash"))


@query("content_hashes")
def content_hashes(spark, folder):
    """Hash of the matching form of title and text (T3, T4); Unicode normal forms have no SQL, unit tests hold them."""
    return table(spark, folder, "raw_items").select("item_id", content_hash(F.col("title"), F.col("summary")).alias("content_hash"))


@query(
    "short_texts",
    """select doc_id, case when length(text) <= 600 then text else regexp_replace(substring(text, 1, 600), ' [^ ]*$', '') || ' …' end as excerpt from documents""",
)
def short_texts(spark, folder):
    """Excerpts of at most 600 characters."""
    return table(spark, folder, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


@query("clean_texts")
def clean_texts(spark, folder):
    """Plain text, first line and sentences of each summary."""
    r = table(spark, folder, "raw_items").where("summary is not null")
    return r.select("item_id", strip_html(F.col("summary")).alias("plain"), first_line(F.col("summary")).alias("first_line"), F.size(sentences(F.col("summary"))).alias("sentences"))


@query(
    "quoted_evidence",
    r"""select mention_id, coalesce(contains(trim(regexp_replace(a.excerpt, '[\s\x{00A0}]+', ' ', 'g')), trim(regexp_replace(m.sentence, '[\s\x{00A0}]+', ' ', 'g'))), false) as verbatim from entity_mentions m left join articles a using (article_id)""",
)
def quoted_evidence(spark, folder):
    """Whether the evidence of each mention stands in its article word for word."""
    m = table(spark, folder, "entity_mentions").select("mention_id", "article_id", "sentence").join(table(spark, folder, "articles").select("article_id", "excerpt"), "article_id", "left")
    return m.select("mention_id", quoted_in(F.col("sentence"), F.col("excerpt")).alias("verbatim"))


@query("shingle_counts")
def shingle_counts(spark, folder):
    """Number of shingles of each headline."""
    return table(spark, folder, "articles").where("title is not null").select("article_id", F.size(shingles(F.col("title"))).alias("shingles"))


@query(
    "record_quality",
    """select item_id, round(((published_at is not null)::int + (coalesce(author, '') <> '')::int + least(1.0, length(coalesce(summary, '')) / 200.0) + case when length(coalesce(title, '')) between 15 and 300 then 1.0 else 0.5 end + 0.0) / 5, 5) as quality from raw_items""",
)
def record_quality(spark, folder):
    """Completeness of each delivered item."""
    r = table(spark, folder, "raw_items")
    return r.select("item_id", F.round(completeness(F.col("published_at").isNotNull(), F.col("author"), F.col("summary"), F.col("title"), F.lit(0.0)), 5).alias("quality"))


@query(
    "relevance_scores",
    f"""with t as (select item_id, lower(coalesce(title, '')) as t, lower(coalesce(summary, '')) as s from raw_items)
    select item_id, case when {hits_sql('t', ['ferry', 'bridge toll'])} > 0 then 1.0 when {hits_sql('s', ['ferry', 'bridge toll'])} > 0 then 0.8 when {hits_sql("t || ' ' || s", ['council'])} > 0 then 0.4 else 0.0 end::double as relevance from t""",
)
def relevance_scores(spark, folder):
    """Relevance by strong and weak terms."""
    return table(spark, folder, "raw_items").select("item_id", relevance(F.col("title"), F.col("summary"), ["ferry", "bridge toll"], ["council"]).alias("relevance"))


@query(
    "jsd_language",
    """with n as (select language as k, cast(count(*) filter (where batch_no = 0) as double) as a, cast(count(*) filter (where batch_no > 0) as double) as b from articles where language is not null group by 1), p as (select a / sum(a) over () as p, b / sum(b) over () as q from n)
    select round((sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / 2, 6) as divergence from p""",
)
def jsd_language(spark, folder):
    """Divergence of languages between the history and the later batches."""
    rows = table(spark, folder, "articles").where("language is not null")
    return js_divergence(rows, "language", (F.col("batch_no") == 0).cast("int"), (F.col("batch_no") > 0).cast("int")).select(F.round("divergence", 6).alias("divergence"))
