import hashlib
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.functions import scoring, stats, terms, text, urls, vectors
from tidewatch.operators.filters import ItemFilter


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_forms(spark):
    fold = text.fold_text
    assert fold("مدرسةٌ  أحمد") == fold("مدرسه احمد") and fold("É١٢") == "e12" and fold(None) == "" and fold("Crème ’x’") == "creme 'x'"
    assert one(spark, text.strip_html(F.col("a")), a="<p>A&nbsp;&amp; b​<br>c</p>") == "A & bc" or one(spark, text.strip_html(F.col("a")), a="<p>A&nbsp;&amp; b​<br>c</p>") == "A & b c"
    assert one(spark, text.content_hash(F.col("a"), F.col("b")), a="É x", b="") == one(spark, text.content_hash(F.col("a")), a="e  X")
    assert [one(spark, text.dominant_script(F.col("a")), a=x) for x in ("abcд", "дд a", "123", "中文")] == ["Latn", "Cyrl", "Zyyy", "Hani"]
    assert one(spark, text.sentences(F.col("a")), a="One here. Two؟ ثلاثة هنا\nok x. a") == ["One here.", "Two؟", "ثلاثة هنا", "ok x."]
    assert one(spark, text.word_count(F.col("a")), a="  a  b\nc ") == 3
    assert one(spark, text.excerpt(F.col("a"), 9), a="abcd efgh ijk") == "abcd …"
    assert one(spark, text.shingles(F.col("a")), a="a b") == ["a b"] and one(spark, text.shingles(F.col("a")), a="a b c d") == ["a b c", "b c d", "a", "b", "c", "d"]
    assert one(spark, text.keyword_label(F.array(*[F.lit(x) for x in ("fish", "fishing", "salt", "sea", "rain", "sun")]))) == "fish, salt, sea, rain"


@pytest.mark.parametrize(
    ("term", "hit", "miss"),
    [
        ("ferry ticket", "two ferry  tickets left", "ferryman tickets"), ("اليمن", "واليمنيين هنا", "يمنع السفر"), ("تعز", "في تعز", "تعزيز"), ("غارة", "غارات جديدة", "غار"), ("كتاب", "بكتابهم", "كتابلى"),
        ("цена", "ценами", "оценка"), ("yemen", "Yemenite's Yémenite", "yemenland"), ("iran", "iranische", "irani5"), ("é", "é", "ea"),
    ],
)
def test_terms_are_whole_words(spark, term, hit, miss):
    assert one(spark, terms.has_any(F.col("a"), [term]), a=hit) and not one(spark, terms.has_any(F.col("a"), [term]), a=miss)


def test_term_index_equals_a_search_for_each_term():
    r = random.Random(2)
    listed = ["ferry ticket", "ticket", "tickets", "اليمن", "يمن", "غارة", "و", "цена", "a", "at", "al", "水", "market-day", ""]
    pieces = ["ferry", "tickets", "ticketed", "at", "a", "واليمن", "لليمن", "بالغارات", "غارته", "ценой", "水道", "market-days", "al's", "!", "و"]
    index = terms.TermIndex(listed)
    for _ in range(300):
        form = text.fold_text(" ".join(r.choices(pieces, k=8)))
        want = sorted((k, m.start(), m.end()) for k, t in enumerate(listed) if t for m in terms.term_pattern(t).finditer(form))
        got = sorted(index.find(form))
        # One after the other, a pattern's matches don't overlap; the index tries every word.
        assert set(want) <= set(got) and {k for k, *_ in got} == {k for k, *_ in want}


def test_content_hash_keeps_parts_apart(spark):
    h = lambda *v: one(spark, text.content_hash(*[F.lit(x) for x in v]))
    assert h("a b", "c") != h("a", "b c") and h("A", None) == h("a ", "") and h("a", "b") == hashlib.sha256(b"a\nb").hexdigest()


def test_ratios():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(9))) for _ in "12")
        want = 100.0 if not a + b else 200 * lcs(a, b) / (len(a) + len(b))
        assert abs(text.indel_ratio(a, b) - want) < 1e-9
    assert text.token_set_ratio("a b c", "c b a b") == 100 and text.token_set_ratio("a b", "a b c d") == 100 and text.token_set_ratio("", "a") == 0
    assert text.token_set_ratio("fish market opens", "fish market closes") < 100


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://WWW.Site.example:80//a//b/?utm_source=x&b=2&a=1&empty=#frag", "https://site.example/a/b?a=1&b=2"), ("https://m.site.example/a/amp/", "https://site.example/a"),
        ("https://site.example:8443/a", "https://site.example:8443/a"), ("https://u:p@site.example/", "https://site.example/"), ("http://site.example", "https://site.example/"),
        ("https://site.example/amp/a.amp.html?outputType=amp&x=a%20b&at_custom1=2&ns_mchannel=z&ocid=3", "https://site.example/a?x=a+b"), ("https://site.example/a.amp?k=~*", "https://site.example/a?k=~%2A"), ("no address", None), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(urls.canonical_url(df["u"])).first()[0] == want


def test_scores(spark):
    def inf(audience, frequency, regional, cited, historical, tier):
        names = ("frequency", "regional_importance", "cited_by_other_media", "historical_importance")
        df = spark.createDataFrame([(audience, frequency, regional, cited, historical, tier)], "a double, f string, r string, c string, h string, t string")
        return df.select(scoring.influence(F.col("a"), dict(zip(names, map(F.col, "frch"))), F.col("t"))).first()[0]

    # 2,000 followers and monthly items: reach 3 and 8; an institution's own ratings don't count.
    assert inf(2_000.0, "monthly", "high", None, "high", "B") == 11.0 and inf(2_000.0, "monthly", "high", None, "high", "A") == 36.0
    assert inf(1e8, "daily", "high", "High", "high", "A") == 100 and inf(None, "daily", "high", "high", "high", "A") is None
    assert inf(1e5, "daily", None, None, None, None) == 45.0 and inf(1e5, None, None, None, None, "A") is None and inf(1e5, "occasional", None, "rare", None, "A") == 20.0
    assert one(spark, scoring.record_problems({"no name": F.lit(False), "ok": F.lit(True), "unknown": F.lit(None).cast("boolean")})) == ["no name", "unknown"]
    assert one(spark, scoring.trend_status(F.lit(1.2), F.lit(6), F.lit(1), F.lit(3))) == "emerging"
    assert [one(spark, scoring.health(F.lit(n))) for n in (0, 2, 3)] == ["healthy", "degraded", "failed"] and one(spark, scoring.run_status(F.lit(1), F.lit(2))) == "partial"


def test_statistics(spark):
    df = spark.createDataFrame([("g", k, w) for k, w in (("a", 1), ("b", 1), ("c", 2))], "g string, k string, w int")
    h = stats.entropy(df, ["g"], "k", F.col("w")).first()["entropy"]
    assert h == pytest.approx(1.5 * math.log(2)) and h <= math.log(3)
    assert stats.js_divergence(df, "k", F.col("w"), F.col("w")).first()[0] == pytest.approx(0)
    far = stats.js_divergence(df, "k", (F.col("k") == "a").cast("int"), (F.col("k") == "b").cast("int")).first()[0]
    assert far == pytest.approx(math.log(2))
    assert stats.js_divergence(df.limit(0), "k", F.col("w"), F.col("w")).first()[0] is None
    maps = stats.distribution(df, ["g"], "k", "m")
    assert rows(stats.merge_distributions(maps.unionByName(maps), ["g"], "m"), "key", "n") == [("a", 2), ("b", 2), ("c", 2)]


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = v.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.unit(F.col("a"))).first()
    assert got[0] == pytest.approx(0.96) and got[1] is None and got[2] == pytest.approx([0.6, 0.8])
    e = spark.createDataFrame([("abc def",), ("",), (None,)], "t string").select(vectors.hashed_embedding(F.col("t"))).collect()
    assert sum(x * x for x in e[0][0]) == pytest.approx(1, abs=1e-5) and len(e[1][0]) == 384


def test_filter_values():
    f = ItemFilter.parse(date(2025, 5, 31), languages="EN, ar", country="xa,xb")
    assert (f.start, f.end, f.languages, f.sources) == (date(2025, 5, 2), date(2025, 6, 1), ("en", "ar"), {"country": ("XA", "XB")})
    for bad in ({"start": "2025-06-02", "end": "2025-06-01"}, {"start": "2020-01-01"}, {"demo": "perhaps"}, {"color": "red"}):
        with pytest.raises(ValueError):
            ItemFilter.parse(date(2025, 6, 30), **bad)
