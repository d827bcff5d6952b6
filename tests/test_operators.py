import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.operators import filters, graphs, lexicon, search, series, topics
from tidewatch.sources import feeds, sinks
from tidewatch.streaming import daily

RSS = b"""<?xml version="1.0" encoding="windows-1256"?><rss><channel><language>ar-SA</language><item><title>A &nbsp; b & c</title><link>https://x.example/1</link><pubDate>Wed, 01 Jan 2025 10:00:00 GMT</pubDate>
<description>&lt;p&gt;Text\x01&lt;/p&gt;</description><category>x</category></item><item><title>no link</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="http://search.yahoo.com/mrss/"><entry><title>Video</title><link rel="alternate" href="https://v.example/1"/><published>2025-01-01T00:00:00Z</published><m:group><m:description>About</m:description></m:group></entry></feed>"""
NEWS = b"""<rss><channel><item><title>Road closed - The Post</title><link>https://n.example/1</link><source url="https://www.post.example">The Post</source></item><item><title>Plain</title><link>https://n.example/2</link></item></channel></rss>"""
INDEX = b'{"articles": [{"url": "https://i.example/1", "title": "T", "seendate": "20250102T030405Z", "domain": "i.example", "language": "Arabic"}, {"url": "", "title": "x"}]}'
PAGE = """<div class="tgme_page"><div class="tgme_widget_message" data-post="c/1"><a class="tgme_widget_message_reply"><div class="tgme_widget_message_text">quoted</div></a><div class="tgme_widget_message_text">First line<br/>second</div><time datetime="2025-01-01T00:00:00+00:00"></time></div>
<div class="tgme_widget_message" data-post="c/2"><img src="x"></div></div>""".encode()


def test_payloads(spark):
    data = [(1, "rss", RSS), (2, "atom", ATOM), (3, "aggregator", NEWS), (4, "index", INDEX), (5, "channel_preview", PAGE), (6, "other", b"<html><body>"), (7, "channel_preview", b"<html></html>"), (8, "rss", None), (9, "index", b"x")]
    got = feeds.parse_payloads(spark.createDataFrame(data, "feed_id int, feed_type string, payload binary")).collect()
    by = {}
    for r in got:
        by.setdefault(r["feed_id"], []).append(r)
    assert [(r["url"], r["title"], r["summary"], r["language_hint"]) for r in by[1]] == [("https://x.example/1", "A b & c", "Text", "ar")]
    assert by[2][0]["summary"] == "About" and by[3][0]["title"] == "Road closed" and by[3][0]["publisher_domain"] == "post.example" and by[3][1]["title"] == "Plain"
    assert by[4][0]["published_at"] == "2025-01-02T03:04:05Z" and by[4][0]["language_hint"] == "ar" and len(by[4]) == 1
    assert [(r["title"], r["summary"]) for r in by[5]] == [("First line", "First line\nsecond")]
    assert all(by[i][0]["error"] and by[i][0]["url"] is None for i in (6, 7, 8, 9))


def test_posts(spark, tmp_path):
    (tmp_path / "posts.csv").write_text("﻿source,url,posted_at,text,language\na,https://a.example/1,2025-01-01T10:00:00Z,hello,en\nzz,https://a.example/1,2025-01-01,x,\na,https://b.example/1,2025-01-01,x,\na,https://a.example/2,soon,x,\na,https://a.example/2,2030-01-01,x,\na,https://a.example/2,2025-01-01,,\n", encoding="utf-8")
    s = spark.createDataFrame([("a", "https://a.example/", "a.example")], "slug string, url string, domain string")
    checked = feeds.check_posts(feeds.read_posts(spark, str(tmp_path / "posts.csv")), s, F.lit("2025-06-01").cast("timestamp"))
    assert sorted(str(r["reason"]) for r in checked.collect()) == sorted(["None", "unknown source", "address of another account", "date can't be read", "date in the future", "no text"])


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"sentiment": {"positive": {"en": ["good", "fine"]}, "negative": {"en": ["bad"]}}}')
    assert feeds.read_vocabulary(spark, str(tmp_path / "v.json"), "sentiment").count() == 3


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d"), (4, "c")], "k int, h string")
    c = sinks.classify_upsert(old, new, "k", "h")
    after, versions = sinks.apply_upsert(c, "k", ["h"])
    assert rows(c, "k", "action") == [(1, "kept"), (2, "unchanged"), (3, "update"), (4, "insert")]
    assert rows(after, "k", "h") == [(1, "a"), (2, "b"), (3, "x"), (4, "d")] and rows(versions, "k", "h") == [(3, "c")]
    assert rows(sinks.classify_upsert(after, new, "k", "h"), "k", "action") == [(1, "kept"), (2, "unchanged"), (3, "unchanged"), (4, "unchanged")]
    days = spark.createDataFrame([(date(2025, 1, d), d) for d in (1, 2)], "day date, n int")
    for _ in range(2):
        sinks.overwrite_days(days, str(tmp_path / "days"))
    sinks.overwrite_days(days.where("n = 2").withColumn("n", F.lit(9)), str(tmp_path / "days"))
    assert rows(spark.read.parquet(str(tmp_path / "days")), "n") == [(1,), (9,)]
    h = spark.createDataFrame([(1, "a", date(2024, 1, 1), None), (2, "b", date(2024, 1, 1), None), (2, "z", date(2023, 1, 1), date(2024, 1, 1))], "k int, p string, valid_from date, valid_to date")
    t = spark.createDataFrame([(1, "a"), (2, "c"), (3, "n")], "k int, p string")
    scd = sinks.close_and_open(h, t, "k", ["p"], F.lit("2025-01-01").cast("date"))
    assert rows(scd.where("valid_to is null"), "k", "p") == [(1, "a"), (2, "c"), (3, "n")] and scd.count() == 5
    h = spark.createDataFrame([(1, "a", "old", date(2024, 1, 1), None), (2, "b", "old", date(2024, 1, 1), None)], "k int, p string, e string, valid_from date, valid_to date")
    t = spark.createDataFrame([(1, "a", "new"), (2, "c", " "), (3, "n", None)], "k int, p string, e string")
    scd = sinks.close_and_open(h, t, "k", ["p"], F.lit("2025-01-01").cast("date"), ["e"])
    assert rows(scd.where("valid_to is null"), "k", "p", "e") == [(1, "a", "new"), (2, "unknown", " "), (3, "unknown", None)] and rows(scd.where("valid_to is not null"), "k", "p") == [(2, "b")]
    guarded = spark.createDataFrame([("=1+1",), ("ok",), (None,)], "x string").select(sinks.guard_formula(F.col("x"))).collect()
    assert [r[0] for r in guarded] == ["'=1+1", "ok", None]
    day = F.lit("2025-01-02").cast("date")
    row = {"title": F.lit("T {x}"), "source": F.lit("Post-Nord"), "day": day, "url": F.lit("u"), "language": F.lit(None).cast("string"), "is_demo": F.lit(True), "excerpt": F.lit("")}
    key = sinks.citation_key(row["source"], day, row["title"], F.lit(7))
    b = spark.range(1).select(sinks.bibtex(key, row, day, "seen"), sinks.ris(row, day), sinks.citation_key(F.lit("P"), day, F.lit("!!"), F.lit(8)), sinks.markdown_row(F.lit("a|b"), F.lit(1))).first()
    assert b[0] == "@misc{postnord2025T7,\n  title = {T \\{x\\}},\n  howpublished = {Post-Nord},\n  year = {2025},\n  date = {2025-01-02},\n  url = {u},\n  language = {},\n  urldate = {2025-01-02},\n  note = {DEMO DATA (synthetic record)}\n}"
    assert b[1] == "TY  - NEWS\nTI  - T {x}\nT2  - Post-Nord\nPY  - 2025\nDA  - 2025/01/02\nUR  - u\nLA  - \nY2  - 2025-01-02\nN1  - DEMO DATA (synthetic record)\nER  - "
    assert b[2] == "p2025item8" and b[3] == "| a\\|b | 1 |"


def test_gate(spark):
    """A future date is now, old and irrelevant items are left out, aggregators are not."""
    now = datetime(2025, 6, 1)
    data = [(1, now + timedelta(hours=7), False, 1.0), (2, now + timedelta(hours=5), False, 0.8), (3, now - timedelta(days=31), True, 1.0), (4, None, True, 0.0), (5, now, False, 0.4), (6, now - timedelta(days=30), True, 0.4)]
    df = spark.createDataFrame([(i, p, now, a, r) for i, p, a, r in data], "id int, published timestamp, now timestamp, aggregator boolean, relevance double")
    got = {r["id"]: (r["decision"], r["published_at"], r["estimated"], r["relevance"]) for r in filters.gate(df, 30).collect()}
    assert got == {1: ("kept", now, False, 1.0), 2: ("kept", now + timedelta(hours=5), False, 0.8), 3: ("old", now - timedelta(days=31), False, 1.0), 4: ("kept", now, True, 0.6), 5: ("irrelevant", now, False, 0.4), 6: ("kept", now - timedelta(days=30), False, 0.4)}


def test_prototype_bonus(spark):
    scores = spark.createDataFrame([(1, "a", True, 2.0)], "item_id int, category string, leaf boolean, score double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.4358898943540674]), (3, [0.0, 1.0])], "item_id int, vector array<double>")
    prototypes = spark.createDataFrame([("a", True, [2.0, 0.0])], "category string, leaf boolean, prototype array<double>")
    got = {r["item_id"]: r["score"] for r in lexicon.with_prototypes(scores, vectors, prototypes).collect()}
    assert got == {1: pytest.approx(6.0), 2: pytest.approx(2.0)}


def test_category_subtree(spark):
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", None), ("a", "c")], "category string, parent string")
    items = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "c", "d", None])], "id int, primary_category string")
    assert rows(filters.in_subtree(items, tree, "b"), "id") == [(0,), (1,), (2,)] and rows(filters.in_subtree(items, tree, "d"), "id") == [(3,)]


def test_sentiment_by_hand(spark):
    """One positive word: shares .75 and .25, strength a quarter, confidence .45 x .8."""
    text = spark.createDataFrame([("a fine day",), ("fine, good and lovely",), ("bad",), ("nothing",), (None,)], "t string")
    s = [r[0] for r in text.select(lexicon.sentiment(F.col("t"), ["fine", "good", "lovely"], ["bad"])).collect()]
    assert (s[0]["label"], s[0]["positive"], s[0]["negative"], s[0]["neutral"], s[0]["confidence"]) == ("neutral", 0.1875, 0.0625, 0.75, 0.36)
    assert (s[1]["label"], s[1]["positive"], s[1]["confidence"]) == ("positive", 0.6563, 0.585) and s[2]["negative"] == 0.1875
    assert all((x["label"], x["neutral"], x["confidence"]) == ("neutral", 0.8, 0.4) for x in s[3:])


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(500, 560)] + [(1000, x) for x in range(1001, 1100)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(rows(graphs.components(spark.createDataFrame(edges, "a int, b int")), "node", "root"))
    assert got == {x: find(x) for x in parent}
    before = spark.createDataFrame([(1001, 77), (1002, 77), (500, 77)], "node int, story_id int")
    ids = dict(rows(graphs.reuse_ids(graphs.components(spark.createDataFrame(edges, "a int, b int")), before), "root", "story_id"))
    assert ids[500] == 77 and ids[1000] == 1000


def test_exact_duplicates(spark):
    t0 = datetime(2025, 1, 1)
    data = [(1, 1, t0, "h"), (2, 1, t0 + timedelta(hours=90), "h"), (3, 2, t0 + timedelta(hours=10), "h"), (4, 2, t0 + timedelta(hours=95), "h"), (5, 2, t0 + timedelta(hours=96), "h"), (6, 9, t0, "single"), (7, 9, t0, None)]
    got = rows(graphs.exact_duplicates(spark.createDataFrame(data, "item_id int, source_id int, at timestamp, hash string")), "item_id", "anchor_id", "kind")
    assert got == [(2, 1, "duplicate"), (3, 1, "syndicated_from"), (5, 4, "duplicate")]


def test_lexicon(spark):
    items = spark.createDataFrame([(1, "Road closed", "The road was closed. Complaints about the closed road in Kisan and Omar met traders! Fine day."), (2, None, None), (3, "", "")], "item_id int, title string, text string")
    f = rows(lexicon.frames(items.where("text is not null"), {"conflict": ["closed", "complaint"], "none": ["zzz"]}), "item_id", "frame", "cues", "evidence")
    assert f == [(1, "conflict", 3, "Complaints about the closed road in Kisan and Omar met traders!")]
    s = items.select("item_id", lexicon.sentiment(F.col("text"), ["fine"], ["closed", "complaint", "road"]).alias("s")).where("item_id = 1").first()["s"]
    assert s["label"] == "negative" and abs(s["positive"] + s["neutral"] + s["negative"] - 1) < 1e-9
    terms = spark.createDataFrame([("roads", "transport", "road"), ("trade", "economy", "trader")], "category string, parent string, term string")
    scores = lexicon.category_scores(items, terms)
    assert rows(scores.where("item_id = 1"), "category", "score") == [("economy", 0.5), ("roads", 4.0), ("trade", 1.0), ("transport", 2.0)]
    c = lexicon.classify(scores).where("rank = 'primary'").first()
    assert c["category"] == "roads" and 0 < c["confidence"] <= 0.97
    aliases = spark.createDataFrame([(1, 10, "Kisan"), (2, 11, "Omar"), (3, 12, "Omar met"), (4, 13, "xy")], "alias_id int, entity_id int, form string")
    m = lexicon.mentions(items, aliases)
    assert rows(m, "entity_id", "surface") == [(10, "Kisan"), (12, "Omar met")]
    e = lexicon.event_candidates(items, m.withColumn("is_place", F.col("entity_id") == 10), {"closure": ["closed"], "talks": ["met"]}, {"talks": 0.7})
    assert rows(e, "event_type", "place_id", "confidence") == [("closure", 10, pytest.approx(0.8))]


def test_event_merge(spark):
    data = [(i, "t", 1, date(2025, 1, d), s, 0.5) for i, d, s in ((1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 10, 1), (5, 2, 1))]
    df = spark.createDataFrame(data, "item_id int, event_type string, place_id int, day date, source_id int, confidence double")
    got = rows(lexicon.merge_events(df), "day", "first_item", "items", "sources", "confidence")
    assert got == [(date(2025, 1, 1), 1, 3, 2, 0.53), (date(2025, 1, 10), 4, 1, 1, 0.5), (date(2025, 1, 3), 3, 1, 1, 0.5)]
    assert rows(lexicon.merge_events(df.orderBy(F.rand(1))), "day", "items") == [(d, n) for d, _, n, _, _ in got]
    assert lexicon.merge_events(df.limit(0)).count() == 0


def test_search(spark):
    items = spark.createDataFrame([(1, "Bridge tolls rise", "the council met"), (2, "Diesel", "bridge tolls"), (3, "x", "bridgetolls diesels"), (4, None, None)], "item_id int, title string, text string")
    both = F.concat_ws(" ", "title", "text")
    hit = lambda q: [r[0] for r in rows(items.where(search.matches(both, q)), "item_id")]
    assert hit('"bridge tolls"') == [1, 2] and hit('"bridge tolls" -council') == [2] and hit("council or diesel") == [1, 2] and hit("") == []
    assert [r["item_id"] for r in search.keyword_search(items, "iesel").collect()] == [2, 3]
    assert search.keyword_search(items, "bridge").first()["item_id"] == 1
    a = spark.createDataFrame([(1, 1), (2, 2)], "item_id int, place int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "item_id int, place int")
    f = search.fuse(a, b).collect()
    assert f[0]["item_id"] == 2 and f[0]["matched_by"] == "both" and f[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and len(f) == 3


def test_topics(spark):
    docs = spark.createDataFrame([(t, i, w) for t, i, w in (("a", 1, "fish salt fish"), ("a", 2, "fish boat salt"), ("b", 3, "road stone"), ("b", 4, "road sand stone"))], "topic string, item_id int, text string")
    terms = topics.document_terms(docs, bigrams=False)
    top = topics.class_tfidf(terms, 4)
    assert top.where("topic = 'a' and place = 1").first()["term"] == "fish"
    npmi = dict(rows(topics.coherence(terms, top.where("place <= 2"), 4), "topic", "npmi"))
    assert npmi["a"] == pytest.approx(1.0) and npmi["b"] == pytest.approx(1.0)
    v = spark.createDataFrame([(i, [1.0, i / 100] if i < 20 else [i / 1000, 1.0]) for i in range(40)], "id int, vector array<double>")
    k = topics.kmeans_topics(v, runs=1)
    assert k.count() == 40 and k.where("probability <= 0 or probability > 1").count() == 0 and topics.topic_count(40) == 4
    assert topics.needs_refit(None, 1, 1) and topics.needs_refit(8, 1, 1) and not topics.needs_refit(1, 13, 10)
    g = topics.align(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.1])], "topic string, centroid array<double>"), spark.createDataFrame([(1, [0.9, 0.1])], "global_id int, global_centroid array<double>"))
    assert rows(g, "topic", "global_id") == [("a", 1), ("b", 2)]


def test_series(spark):
    d = lambda n: date(2025, 1, n)
    data = [(d(14 - i), "k", i % 3, "en") for i in range(7) for _ in range(2)] + [(d(3), "k", 1, "en"), (d(14), None, 1, "en")]
    t = series.trends(spark.createDataFrame(data, "day date, key string, source_id int, language string"), "key").first()
    assert (t["recent"], t["previous"], t["sources"], t["status"]) == (14, 1, 3, "emerging") and t["growth"] == 6.5
    dense = series.dense_days(spark.createDataFrame([(d(1), "a", 2), (d(4), "b", 1)], "day date, key string, n int"), "key")
    assert dense.count() == 8 and dense.agg(F.sum("n")).first()[0] == 3


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    items = spark.createDataFrame([(i, f"u{i % 40}", t0 + timedelta(hours=3 * i)) for i in range(120)], "id int, url string, fetched_at timestamp")
    items.repartitionByRange(6, "fetched_at").write.parquet(str(tmp_path / "in"))
    schema = "id int, url string, fetched_at timestamp"
    stream = lambda: daily.item_stream(spark, str(tmp_path / "in"), schema, 2)
    q = daily.run_into(daily.windowed_counts(daily.clamp_future(stream()), "fetched_at", "url", "1 day"), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] <= 120 and got.count() > 0  # windows that may still change are held back
    q = daily.recompute_days(stream(), str(tmp_path / "items"), str(tmp_path / "days"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    want = rows(items.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "n")
    assert rows(spark.read.parquet(str(tmp_path / "days")), "day", "n") == want
    once = daily.run_into(daily.once_per_key(stream(), "url", "fetched_at", "30 days"), str(tmp_path / "once"), str(tmp_path / "c3"))
    once.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 40


def test_near_duplicates_and_links(spark):
    from tidewatch.operators import similar

    t0, title, body = datetime(2025, 1, 1), "road to kisan closed for three days", "the road was closed by the council " * 3
    data = [(1, 1, t0, "en", title, body), (2, 1, t0 + timedelta(hours=20), "en", title, body), (3, 2, t0 + timedelta(hours=30), "en", title + " now", body), (4, 3, t0 + timedelta(hours=100), "en", title, body), (5, 3, t0 + timedelta(hours=1), "en", "a quite different headline here", ""), (6, 4, t0 + timedelta(hours=31), "en", title, "another text of the same story " * 4), (7, 5, None, "en", title, None)]
    got = rows(similar.near_duplicates(spark.createDataFrame(data, "item_id int, source_id int, at timestamp, language string, title string, text string")), "item_id", "other_id", "kind")
    assert got == [(2, 1, "duplicate"), (3, 1, "syndicated_from"), (3, 2, "same_story"), (6, 1, "same_story"), (6, 2, "same_story"), (6, 3, "same_story")]
    v = spark.createDataFrame([(1, 1, t0, [1.0, 0.0]), (2, 2, t0, [1.0, 0.0]), (3, 2, t0 + timedelta(days=2), [0.9, 0.2]), (4, 3, t0 + timedelta(days=9), [1.0, 0.0])], "item_id int, source_id int, at timestamp, vector array<double>")
    assert rows(similar.semantic_links(v, 0.99, 0.9), "item_id", "other_id", "kind") == [(2, 1, "same_story"), (3, 1, "similar"), (3, 2, "similar")]
    m = spark.createDataFrame([(1, "sentiment", "positive", "lexicon", 0.4, 1)], "item_id int, measure string, value string, method string, confidence double, version int")
    c = spark.createDataFrame([(1, "sentiment", "negative", "2025-01-01"), (2, "other", "x", "2025-01-01")], "item_id int, measure string, value string, decided_at string")
    assert rows(similar.apply_corrections(m, c), "value", "is_current") == [("negative", True), ("positive", False)]
    fresh = similar.model_stage(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "content_hash string, text string"), spark.createDataFrame([("b",)], "content_hash string"), lambda p: p.assign(label=p["text"] * 2)[["content_hash", "label"]], "content_hash string, label string")
    assert rows(fresh, "content_hash", "label") == [("a", "xx")]


def test_near_duplicates_miss_no_pair(spark):
    """Against brute force: headlines contained in longer ones, reworded, and without a word in common."""
    from tidewatch.functions.text import token_set_ratio
    from tidewatch.operators import similar

    t0, heads = datetime(2025, 1, 1), [f"{a} {b} {c} {d}" for a in ("roads", "bridges") for b in ("closed", "opened") for c in ("near", "beyond") for d in ("kisan", "hutas", "muril")]
    data = []
    for n, head in enumerate(heads):
        longer = f"{head} as the council of the whole province decides about lorries and ferries for season {n}"
        slips = " ".join(w + "s" for w in head.split())
        reworded = f"{head} after {n} days of talks in town"
        data += [(10 * n + k, k, t0 + timedelta(hours=(7 * n + 5 * k) % 90), "en", x, "") for k, x in enumerate((head, longer, slips, reworded, reworded.replace("talks", "long talk"), " ".join(reversed(longer.split()))))]
    s = lambda r: (r[2], r[0])
    want = {(a[0], b[0]) for a in data for b in data if s(b) < s(a) and a[2] - b[2] <= timedelta(hours=48) and token_set_ratio(a[4], b[4]) >= 88}
    assert any(not set(data[i // 10 * 6 + i % 10][4].split()) & set(data[j // 10 * 6 + j % 10][4].split()) for i, j in want)
    items = spark.createDataFrame(data, "item_id int, source_id int, at timestamp, language string, title string, text string")
    for most in (4000, 5):
        assert {tuple(r) for r in similar.near_duplicates(items, links=1000, most=most).select("item_id", "other_id").collect()} == want
