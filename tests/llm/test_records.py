"""Problems 2, 7 and 9 against plain versions, and with nulls, ties, repeats and empty tables."""

import random
from itertools import permutations

import numpy as np
import pytest

from tests.conftest import rows
from tidewatch.llm.batches import RUN, TEXTLESS, AcceptedHistory, Words, blocks_of, duplicates, gram_codes, headline_words, mark_keys, order_keys, page_of, same_but_for_slips, same_report, text_words, winnow, winnow_all
from tidewatch.llm.mixing import TOKENIZER, DomainClassifier, fit_rates, mix, reached_shares
from tidewatch.llm.names import cheapest_pairing, group_unknown, link_names, match_cost, typing_errors, words_of_name

RECORD = "id long, batch int, url string, title string, text string, key string, first long"
BODY = "Drivers in Kisan told our desk that tickets had been promised 325 times since spring. A letter from Hutas lists 200 complaints about diesel and the road stayed open all day long"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://www.x.example/a/b/?utm_source=q#top", "http://m.x.example:80/a/b/amp", True), ("https://x.example/view?id=1&sec=n", "https://X.EXAMPLE/view/?sec=n&id=1&fbclid=2", True),
        ("https://x.example/view?id=1", "https://x.example/view?id=2", False), ("https://x.example/a", "https://y.example/a", False),
    ],
)
def test_page_of(a, b, same):
    assert (page_of(a) == page_of(b)) is same
    assert page_of(None) == page_of("") == page_of("http://[bad") == ""


def test_headlines():
    assert headline_words("UPDATE: “Road to Kisan closed, 3 lorries stranded” - Kisan Post")[0] == "road to kisan closed 3 lorries stranded".split()
    assert headline_words(None) == ([], [])


def test_slips():
    a = "the road to kisan was closed by 3 drivers".split()
    assert same_but_for_slips(a, "the raod to kisan was closd by 3 drivers".split())
    assert not same_but_for_slips(a, "the road to kisan was closed by 4 drivers".split())
    assert not same_but_for_slips(a, "the road to hutas was closed by 3 drivers".split())
    assert not same_but_for_slips("from kisan to kisan by day".split(), "from kisen to kisen by day".split())


def _records():
    change = lambda old, new: BODY.replace(old, new)
    return [
        (1, 0, "https://a.example/x/1", "Drivers in Kisan wait for 325 tickets", BODY), (2, 0, "https://a.example/x/2", "Letters to the desk", BODY.replace("Kisan", "Muril").replace("325", "12").replace("200", "7")),
        (3, 0, None, None, None), (4, 0, "", "", ""),
        (10, 1, "https://b.example/9", "UPDATE: DRIVERS IN KISAN WAIT FOR 325 TICKETS - B Post", change("told", "todl")), (11, 1, "http://www.a.example/x/1/?ref=q", "Another headline", "quite another text of this page"),
        (12, 1, "https://b.example/12", "Drivers in Kisan wait for 326 tickets", change("325", "326")), (13, 1, "https://b.example/13", "Letters to the desk", "something else that was sent to the desk today by 5 readers"),
        (14, 1, None, None, None), (15, 2, "https://c.example/15", "Drivers in Kisan wait for 326 tickets", change("325", "326")), (16, 2, "https://c.example/16", "Drivers in Muril wait for 325 tickets", change("Kisan", "Muril")),
        (17, 2, None, "Drivers in Kisan wait for 325 tickets!", None), (18, 2, None, None, BODY + "x" * 50_000),
    ]


WANT = {10: 1, 11: 1, 15: 12, 17: 1}


def _frame(spark, data):
    return spark.createDataFrame([(*r[:5], "k", 5) for r in data], RECORD)


def test_duplicates(spark):
    df = _frame(spark, _records())
    assert dict(rows(duplicates(df), "id", "first")) == WANT
    assert dict(rows(duplicates(df.unionByName(df), window=1, range_rows=20), "id", "first")) == WANT
    assert duplicates(df.limit(0)).count() == 0


def test_another_session_goes_on_with_the_folder(spark, tmp_path):
    """Each batch in a store of its own; runs are compacted, and what is no more in use is deleted."""
    folder, got = str(tmp_path / "history"), {}
    again = [(110, 3, *_records()[4][2:])]
    for batch in range(4):
        part = _frame(spark, [r for r in [*_records(), *again] if r[1] == batch]).drop("batch")
        store = AcceptedHistory(spark, folder, fan=2, range_rows=10)
        got |= dict(rows(store.accept(part, batch), "id", "first"))
    assert got == WANT | {110: 1} and len(store.runs) <= 3 and sum(r["rows"] for r in store.runs) == 14
    assert len(list((tmp_path / "history").iterdir())) == 2 * len(store.runs) + 1
    with pytest.raises(ValueError, match="after 3"):
        store.accept(part, 3)


def test_a_large_group_of_copies(spark):
    """More copies than any window, over several ranges of keys, of which none but the first leaves marks."""
    data = [(i, i // 80, f"https://s{i}.example/{i}", "Drivers in Kisan wait for 325 tickets", BODY) for i in range(300)]
    data += [(1000 + i, 1, f"https://t{i}.example/{i}", "Letters to the desk", f"reader {i} wrote {i * 7} lines about {'abcdefghij'[i % 10] * 5} things") for i in range(100)]
    got = dict(rows(duplicates(_frame(spark, data).repartition(6), window=5, range_rows=100), "id", "first"))
    assert set(got) == set(range(1, 300)) and set(got.values()) == {0}


def test_a_copy_far_from_its_original_in_every_order(spark):
    """Reports that differ in numbers share their headline; the copy's original is not near it."""
    told = lambda n: BODY.replace("325", str(1000 + n))
    slipped = told(0).replace("promised", "promisde")
    data = [(i, 0, f"https://s{i}.example/{i}", "Drivers in Kisan wait for 325 tickets", told(i)) for i in range(60)]
    data += [(100, 1, "https://t.example/1", "Drivers in Kisan wait for 325 tickets", slipped), (101, 1, "https://t.example/2", "Driver in Kisan wait for 325 tickets now", slipped)]
    data += [(102, 1, "https://t.example/3", None, told(30)), (103, 2, "https://t.example/4", "Divers in Kisan wait for 325 tickets", None), (104, 2, None, None, None)]
    got = dict(rows(duplicates(_frame(spark, data), window=3), "id", "first"))
    assert got == {100: 0, 101: 0, 102: 30, 103: 0}
    assert blocks_of("5 of 12 roads".split(), "kisan 5 of 12 roads".split()) == ["5 12"] and blocks_of([], ["x"]) == []


def test_shortened_reports(spark):
    """Reports of 150 words, each with a later version of 25 words under the same headline without numbers."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghiklmnoprstu", k=r.randint(3, 9))) for _ in range(2000)]
    data = []
    for i in range(200):
        text, at = r.choices(words, k=150), r.choice([0, 125])
        data += [(i, 0, None, f"Letters {i % 3} to the desk".replace(f" {i % 3}", ""), " ".join(text)), (1000 + i, 1 + i % 2, None, "Letters to the desk", " ".join(text[at : at + 25]))]
    got = dict(rows(duplicates(_frame(spark, data)), "id", "first"))
    assert got == {1000 + i: i for i in range(200)}


def _chains():
    """Reports whose versions each differ from the one before by a slip in the headline, so that far ones are not the same."""
    r, data = random.Random(4), []
    for i in range(8):
        head = [f"{w}{'abcdefgh'[i] * 3}" for w in "drivers roads letters tickets water school market".split()]
        text = " ".join(f"{'abcdefgh'[i]}{'klmnopqr'[k % 8]}{'stuvwxyz'[k // 8]}word" for k in range(40))
        for v in range(7):
            data.append((100 * r.randint(1, 9) + 10 * v + i, r.randint(0, 3), None, " ".join(head), text))
            head[v] = head[v][1] + head[v][0] + head[v][2:]
    return list({x[0]: x for x in data}.values())


def _plain_firsts(data):
    """The rule for every pair, one record after the other."""
    first, seen = {}, []
    for i, batch, url, title, text in sorted(data, key=lambda x: (x[1], x[0])):
        head, whole = headline_words(title)
        body = " ".join(text_words(text))
        now = {"page": page_of(url), "headline": " ".join(head), "whole": " ".join(whole), "body": body, "flag": TEXTLESS * (not body)}
        met = [(b, o) for b, o, old in seen if same_report(old, now)]
        if past := [first.get(o, (b, o)) for b, o in met if b < batch]:
            first[i] = min(past)
        elif met:
            first[i] = first.get(min(met)[1], min(met))
        seen.append((batch, i, now))
    return {i: o for i, (_, o) in first.items()}


def test_batches_that_wait_are_accepted_as_one_after_the_other(spark, tmp_path):
    """Chains over several batches and within one, all pairs by the plain rule, and each batch for itself."""
    data, single = _chains(), {}
    store = AcceptedHistory(spark, str(tmp_path / "single"))
    for batch in range(4):
        single |= dict(rows(store.accept(_frame(spark, [x for x in data if x[1] == batch]).drop("batch"), batch), "id", "first"))
    assert dict(rows(duplicates(_frame(spark, data)), "id", "first")) == single == _plain_firsts(data)
    assert len(single) > 20 and len(set(single.values())) > 8


def test_jobs_do_not_grow_with_the_batches(spark):
    """Each job costs the driver memory and time, whatever its size."""
    jobs = []
    for batches in (3, 9):
        data = [(i, i % batches, f"https://a.example/{i}", f"Headline number {i} of the day", " ".join(f"w{i}x{k}" for k in range(20))) for i in range(36)]
        spark.sparkContext.setJobGroup(f"{batches} batches", "")
        assert duplicates(_frame(spark, data)).count() == 0
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{batches} batches")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 1.2 * jobs[0]


def test_rows_read_for_a_batch_do_not_grow_with_the_history(spark, tmp_path):
    """A history four times as large has four times the ranges; the batch touches as many of them as before."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    read = []
    for n in (400, 1600):
        store = AcceptedHistory(spark, str(tmp_path / str(n)), range_rows=300)
        store.accept(_frame(spark, [(i, 0, f"https://a.example/{i}", f"Headline number {i} of the day", text(i)) for i in range(n)]).drop("batch"), 0)
        asked = []
        take = store._read
        store._read = lambda what, runs, touched=None, take=take, asked=asked: asked.append(take(what, runs, touched)) or asked[-1]  # noqa: B023
        got = store.accept(_frame(spark, [(9999, 1, None, "Headline number 7 of the day", text(7))]).drop("batch"), 1)
        assert rows(got, "id", "first") == [(9999, 7)]
        read.append(sum(x.count() for x in asked))
        assert store.state["ranges"] > 8
    assert read[1] < 1.5 * read[0]


def test_winnowed_marks_are_shared_by_common_runs():
    r, known = random.Random(3), {}
    for _ in range(200):
        common = [f"c{r.random()}" for _ in range(RUN)]
        a, b = ([f"{x}{r.random()}" for _ in range(r.randint(0, 30))] + common + [f"{x}{r.random()}" for _ in range(r.randint(0, 30))] for x in "ab")
        assert set(winnow(gram_codes(a, 5, known), 5, RUN)) & set(winnow(gram_codes(b, 5, known), 5, RUN))
    assert winnow(gram_codes(["a"] * 4, 5, known), 5, RUN) == [] and mark_keys([], [], [], {}) == []


def test_phrases_of_fewer_words_than_a_report_needs_make_no_pairs():
    """Texts with nine words in common are no candidates, those with twelve are; pairs of phrases grow with the square of the rows."""
    r, head = random.Random(7), "Drivers in Kisan wait for 325 tickets".lower().split()
    own = lambda n: [f"x{r.random()}".replace(".", "") for _ in range(n)]
    phrase = own(RUN)
    marks = lambda n: set(mark_keys(head[:4], head[:4], own(9) + phrase[:n] + own(9), {}))
    assert not any(marks(9) & marks(9) for _ in range(50)) and all(marks(RUN) & marks(RUN) for _ in range(50))


def test_words_and_marks_of_many_texts_are_those_of_each():
    r, words = random.Random(8), Words()
    texts = ["".join(r.choice("aİßﬁ²() -–:ـً\u200bأة٣\n") for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["(Kisan Post) - three more words", None]
    for text in texts:
        assert words.of_text(text)[0].split() == text_words(text) and headline_words(text, words) == headline_words(text)
    assert text_words("(Kisan Post) - three more words") == ["three", "more", "words"]
    many = [[f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 30))] for _ in range(300)]
    codes = gram_codes([w for x in many for w in x], 1, {})
    owner, values = winnow_all(codes, np.array(list(map(len, many))), 5, RUN)
    for i, x in enumerate(many):
        own = codes[sum(map(len, many[:i])) :][: len(x)]
        left, least = winnow_all(own, np.array([len(x)]), 5, RUN)
        assert values[owner == i].tolist() == least.tolist() and (len(least) > 0) == (len(x) >= RUN) and set(left) <= {0}


def test_long_order_keys_stay_apart():
    """Beyond 400 characters a headline keeps a hash of the whole, followed by the hash of its text."""
    a, b = (order_keys(["w" * 99] * 9, text) for text in "xy")
    c = order_keys(["w" * 99] * 8 + ["v"], "x")
    assert len({*a, *b, *c}) == 6 and all(len(k) <= 400 for k in (*a, *b, *c)) and order_keys(["a"], "x") == []


NAMES = [(1, False, "Abdulrahman Mafabus"), (1, False, "عبدالرحمن مافابوس"), (1, False, "Mafabus"), (2, False, "Dawud Ligajas"), (3, False, "Hassan Ligajas"), (4, True, "Kizujam Election Commission"), (4, True, "KEC"), (5, True, "Mujiran Fishermen Association"), (6, True, "Gulunam Water Board"), (7, True, "Gulunam Development Fund"), (8, False, "Robert al-Baradin")]


def test_link_names(spark):
    want = {
        "Mafabus, Abdulrahman": 1, "A. Mafabus": 1, "Abdo Mafabus": 1, "Abdulrahman Mafabous": 1, "Dr. Abdulrahman  Mafabus": 1, "ع. مافابوس": 1, "السيد عبدالرحمن مافابوس": 1, "Abdlurahman Mafabsu": 1, "ABDULRAHMAN MAFABUS": 1,
        "D. Ligajas": 2, "Ligajas": None, "Tariq Ligajas": None, "Hasan Ligajas": 3, "K.E.C.": 4, "the Election Commission in Kizujam": 4, "Mujiran Development Fund": None, "the Gulunam water bd": 6, "Gulunam Dev. Fund": 7,
        "alBaradin R.": 8, "el Baradin, Robert": 8, "": None, None: None, "Dr.": None, "x" * 50_000: None, "Hassan Risijil": None,
    }
    forms = spark.createDataFrame([(f, "x") for f in [*want, *want]], "form string, words string")
    spellings = spark.createDataFrame(NAMES + NAMES[:3], "entity_id int, is_org boolean, form string")
    assert dict(rows(link_names(forms, spellings), "form", "entity_id")) == {k: v for k, v in want.items() if v}
    assert link_names(forms.limit(0), spellings).count() == 0 and link_names(forms, spellings.limit(0)).count() == 0


def test_long_names_and_common_words(spark):
    """Names of many words, and forms whose only unshortened word belongs to many entities."""
    long = "Kizujam Mujiran Gulunam Bazinas Water Roads Schools Commission"
    listed = [(1, True, long), (2, False, "Robert Common"), *[(10 + i, False, f"{'abcdefghij'[i]}ulimar Common") for i in range(10)]]
    spellings = spark.createDataFrame(listed, "entity_id int, is_org boolean, form string")
    want = {long: 1, long.replace("Mujiran", "Mujirna"): 1, "Bob Common": 2, "R. Common": 2, "Common, Bob": 2, "B. Comon": 11, "X. Common": None, "Common": None}
    forms = spark.createDataFrame([(f,) for f in want], "form string")
    assert dict(rows(link_names(forms, spellings, shared_by=3), "form", "entity_id")) == {k: v for k, v in want.items() if v}


def test_chains_of_any_length(spark):
    """Each spelling is one error from the one before it; all are merged, round by round."""
    chain = ["Abcdefghij Klmnopqrst", "Abcdefghix Klmnopqrst", "Abcdefghix Klmnopqrsy", "Abcdefgzix Klmnopqrsy"]
    forms = spark.createDataFrame([(f,) for f in chain], "form string")
    got = link_names(forms, spark.createDataFrame([(1, False, chain[0])], "entity_id int, is_org boolean, form string"))
    assert dict(rows(got, "form", "entity_id")) == dict.fromkeys(chain, 1)


def test_group_unknown(spark):
    forms = ["Tariq Musadim", "Tarik Musadim", "Musadim, Tariq", "Nadia Bubulun", "Nadia Bubulun", None, "", "Omar Musadim"]
    got = dict(rows(group_unknown(spark.createDataFrame([(f,) for f in forms], "form string")), "form", "group"))
    assert got == {"Tariq Musadim": "Musadim, Tariq", "Tarik Musadim": "Musadim, Tariq", "Musadim, Tariq": "Musadim, Tariq", "Nadia Bubulun": "Nadia Bubulun", "Omar Musadim": "Omar Musadim"}
    assert group_unknown(spark.createDataFrame([], "form string")).count() == 0


def test_cheapest_pairing_equals_all_permutations():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 5)
        costs = [[r.choice([None, 0.0, 0.1, 0.3, 1.0]) for _ in range(n)] for _ in range(n)]
        totals = [sum(costs[i][p[i]] for i in range(n)) for p in permutations(range(n)) if all(costs[i][p[i]] is not None for i in range(n))]
        got = cheapest_pairing(costs)
        assert (got is None) == (not totals) and (got is None or sum(costs[i][j] for i, j in enumerate(got)) == pytest.approx(min(totals)))


def test_name_parts():
    assert typing_errors("mafabus", "mfaabus") == 1 and typing_errors("abc", "xyz", 2) == 3
    assert words_of_name("Minister Tariq el-Musadim") == ["tariq", "musadim"] and words_of_name(None) == []
    assert match_cost(["bob", "bubulun"], ["robert", "bubulun"], "bubulun", False) is not None
    assert match_cost(["tariq", "bubulun"], ["robert", "bubulun"], "bubulun", False) is None


def _corpus():
    out = []
    for s, n in (("a", 200), ("b", 60), ("c", 15), ("z", 50)):
        out += [(i + 1000 * ord(s), f"{s} " * (20 + i % 50) + "words and more words", s, "k") for i in range(n)]
    return [*out, (1, None, "a", "k"), (2, "", "b", "k"), (3, "long " * 20_000, "z", "k")]


def test_mix(spark):
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    got = mix(docs, targets)
    caps = {"a": 1, "b": 3, "c": 4}
    assert all(0 < r["uses"] <= caps[r["source"]] for r in got.collect())
    for r in reached_shares(got, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01, r
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0
    assert mix(docs.repartition(7), targets).exceptAll(got).count() == 0


def test_soft_membership(spark):
    """Documents without a source take part by their posteriors, those of other sources don't; expected shares meet the targets."""
    unknown = [(5000 + i, "a a a a a a words" if i % 2 else "b b b b a words", [None, "", " "][i % 3], "k") for i in range(40)]
    docs = spark.createDataFrame(_corpus() + unknown, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    got = mix(docs, targets).collect()
    assert any(r["source"] is None for r in got) and {r["source"] for r in got} <= {"a", "b", None} and all(abs(sum(r["weights"]) - 1) < 1e-9 for r in got)
    reached = {r["source"]: r for r in reached_shares(mix(docs, targets), targets).collect()}
    assert abs(reached["a"]["expected_share"] - 0.6) < 0.01 and abs(reached["b"]["expected_share"] - 0.4) < 0.01
    assert sum(r["actual_share"] for r in reached.values()) == pytest.approx(1) and reached[None]["actual_share"] > 0
    model = DomainClassifier(["a", "b"], [("a", "a a a words"), ("b", "b b b words")])
    assert model.posterior("a a").argmax() == 0 and abs(model.posterior("b").sum() - 1) < 1e-6


def test_rates_meet_targets():
    mass = np.array([[1000.0, 0, 0], [0, 50, 0], [0, 0, 400], [30, 20, 10]])
    rates = fit_rates(mass, np.array([1.0, 8.0, 2.0, 1.0]), np.array([0.5, 0.2, 0.3]))
    used = rates @ mass
    assert np.allclose(used / used.sum(), [0.5, 0.2, 0.3], atol=1e-3) and (rates <= [1.0001, 8.0001, 2.0001, 1.0001]).all() and (rates >= 0).all()


def test_tokenizer_is_a_parameter():
    from tidewatch.llm.mixing import tokenizer

    text = "Zwei Lehrerinnen, ٣ دفاتر <|endoftext|>"
    t = tokenizer(TOKENIZER)
    assert t.decode(t.encode_ordinary(text)) == text
