"""Problems 3, 4, 8 and 10 against plain versions, and with nulls, empty and long texts, ties, repeats, empty tables."""

import random

import numpy as np
import pytest

from tests.conftest import rows
from tidewatch.llm.boilerplate import TemplateTree, repeated_lines, shared_lines, without_repeated
from tidewatch.llm.forms import comparable_form, look_alike_pairs, normal_form, normalise, visual_form
from tidewatch.llm.languages import fit, label_code, languages_of, mislabelled, mixture, segments_of, sentence_places, sentences_of
from tidewatch.llm.leaks import block_masks, find_leaks, item_places, weighted_similarity, window_prints, word_codes, words_of

TEXT = "doc_id long, text string, normal string, source string"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ｆｕｌｌ ｗｉｄｔｈ", "full width", True), ("été", "été", True), ("ofﬁce", "office", True), ("pаge", "page", True), ("ё", "ë", True), ("a​b­c", "abc", True),
        ("a b", "a b", True), ("١٢", "۱۲", True), ("٤", "۴", False), ("Page", "page", False), ("ete", "éte", False), ("ı", "i", False), ("5", "٥", False), ("vaϲϲine", "vaccine", True),
        ("10²", "102", False), ("10²", "10₂", False), ("①", "1", False), ("½", "1⁄2", False), ("می‌خواهم", "میخواهم", False), ("در‌آن", "درآن", True), ("ﻣﯽ‌خواهم", "می‌خواهم", True), ("a‌b", "ab", True),
    ],
)
def test_visual_form(a, b, same):
    assert (visual_form(a) == visual_form(b)) is same
    assert visual_form(visual_form(a)) == visual_form(a)
    if same:
        assert normal_form(a) == normal_form(b)


def test_comparable_forms_drop_joiners_and_raised_digits():
    assert normal_form("می‌خواهم") == normal_form("میخواهم") and normal_form("10²") == "102"


def test_comparable_form_ignores_case_in_all_scripts():
    for text in ("Спор про рыночные разрешения", "Straße nach Rahifas", "Ρο ϲ"):
        assert comparable_form(text.upper()) == comparable_form(text.lower()) or "ß" in text
    assert normal_form(None) is None and comparable_form("") == ""


def test_look_alike_pairs(spark):
    base = ["the page of the office", "thе page of the ofﬁce", "The page of the office", "the page of the office", None, "", "x" * 200_000, "x" * 199_999 + "х"]
    df = spark.createDataFrame([(i, t, "n", "s") for i, t in enumerate(base)], TEXT)
    assert rows(look_alike_pairs(df), "doc_id_a", "doc_id_b") == [(0, 1), (1, 3), (6, 7)]
    assert look_alike_pairs(df.limit(0)).count() == 0
    many = spark.range(200_000).selectExpr("id as doc_id", "if(id = 77777, 'pаge', 'page') as text")
    pairs = look_alike_pairs(many)
    assert pairs.count() == 199_999 and pairs.where("doc_id_a <> 77777 and doc_id_b <> 77777 or doc_id_a >= doc_id_b").isEmpty()
    assert dict(rows(normalise(df), "doc_id", "form"))[4] is None


def _plain_lines(data, least, share):
    key = lambda s: TemplateTree().signature(s) and TemplateTree().signature(s)[0]
    seen, size = {}, {}
    for i, s, t in data:
        size[s] = size.get(s, 0) + 1
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            seen.setdefault((s, k), set()).add(i)
    return sorted(((i, n) for i, s, t in data if t for n, x in enumerate(t.split("\n"), 1) if key(x) and len(seen[s, key(x)]) >= max(least, share * size[s])), key=repr)


def test_repeated_lines(spark):
    r = random.Random(1)
    lines = ["Shared 12 times", "SHARED 9  TIMES", "Shared  7​ times", "only once", "Paylaşıldı İ", "paylaşıldı i", "", "  ", "123", "Straße", "STRASSE"]
    data = [(i, r.choice([1, 1, 2, None]), r.choice([None, "", "\n".join(r.choice(lines) + r.choice(["", "", f" {i} x{'y' * (i % 7)}"]) for _ in range(4))])) for i in range(300)]
    df = spark.createDataFrame([(*d, "clash", 3) for d in data], "row_id long, source_id int, text string, template string, line_no int").repartition(5)
    got = rows(repeated_lines(df, 8, 0.05, tree_size=50), "row_id", "line_no")
    assert got == _plain_lines(data, 8, 0.05) and got
    clean = dict(rows(without_repeated(df, repeated_lines(df)), "row_id", "text"))
    gone = set(got)
    for i, _, t in data:
        assert clean[i] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone))
    assert repeated_lines(df.limit(0)).count() == 0


def test_shared_lines_ignore_own_names(spark):
    data = [(i, i % 5, [f"Name{i % 5}x"], f"Follow NAME{i % 5}X today\nunique words {'abcdefghijklmnopqrst'[i]}\n#tag{i} #news", i // 10) for i in range(20)]
    df = spark.createDataFrame(data, "row_id long, source_id int, names array<string>, text string, batch int")
    want = lambda ids: sorted([(i, n) for i in ids for n in (1, 3)], key=repr)
    assert rows(shared_lines(df), "row_id", "line_no") == want(range(20))
    assert rows(shared_lines(df, least_rows=12), "row_id", "line_no") == want(range(10, 20))  # known with the second batch


SAMPLE = {
    "en": "the council of the town said that the road would be closed and the market would open again in the morning",
    "de": "der rat der stadt sagte dass die straße gesperrt sei und der markt am morgen wieder öffnen werde und nicht",
    "fr": "le conseil de la ville a dit que la route serait fermée et que le marché ouvrirait de nouveau le matin",
    "ru": "совет города сообщил что дорога будет закрыта а рынок снова откроется утром и работа продолжится",
    "ar": "قال مجلس المدينة إن الطريق سيغلق وإن السوق سيفتح من جديد في الصباح بينما بقي الناس في الخارج",
}


def _texts(n, seed=0):
    r = random.Random(seed)
    return [(" ".join(r.sample(SAMPLE[c].split(), 12)) + ".", c) for c in SAMPLE for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    noisy = _texts(40)
    return fit([(t, "de" if i % 17 == 0 else c) for i, (t, c) in enumerate(noisy)])


def test_languages_by_held_out_accuracy(spark, model):
    texts = _texts(20, seed=9)
    df = spark.createDataFrame([("t", i, c.upper(), t, "x") for i, (t, c) in enumerate(texts)], "table_name string, row_id long, label string, text string, language string")
    got = dict(rows(languages_of(df.drop("language"), model), "row_id", "language"))
    assert np.mean([got[i] == c for i, (_, c) in enumerate(texts)]) > 0.97
    assert rows(mislabelled(languages_of(df, model)), "row_id") == sorted([(i,) for i, (_, c) in enumerate(texts) if got[i] != c], key=repr)


def test_mixed_and_odd_texts(spark, model):
    en, fr, ru = (_texts(1)[i][0] for i in (0, 2, 3))
    odd = [f"{en} {fr}\n{ru}", en[:-1] + ' ("pain et sel").', None, "", "12 34", "und", en * 3_000]
    df = spark.createDataFrame([("t", i, "en_GB", t) for i, t in enumerate(odd)], "table_name string, row_id long, label string, text string")
    got = {}
    for i, lang, sure in rows(languages_of(df, model), "row_id", "language", "confidence"):
        assert 0 <= sure <= 1
        got.setdefault(i, set()).add(lang)
    assert got[0] == {"en", "fr", "ru"} and got[1] == {"en"} and got[6] == {"en"} and not {2, 3, 4} & set(got)
    assert languages_of(df.limit(0), model).count() == 0


def test_segments(spark, model):
    """Nine of ten planted stretches come out with their language, and together they cover the text's sentences."""
    r = random.Random(7)
    planted, data = [], []
    for i in range(60):
        at, text = 0, ""
        for k in range(r.choice([1, 2, 3])):
            code = r.choice([c for c in SAMPLE if not planted or planted[-1][0] != i or planted[-1][3] != c])
            piece = " ".join(" ".join(r.sample(SAMPLE[code].split(), 9)) + "." for _ in range(2))
            planted.append((i, at, at + len(piece), code))
            text += piece + r.choice([" ", "\n"])
            at = len(text)
        data.append(("t", i, None, text))
    df = spark.createDataFrame([*data, ("t", 99, None, None), ("t", 98, None, "")], "table_name string, row_id long, label string, text string")
    got = segments_of(df, model).collect()
    found = {(x["row_id"], x["start"], x["stop"], x["language"]) for x in got}
    assert len(found & set(planted)) >= 0.9 * len(planted) and all(0 < x["confidence"] <= 1 for x in got)
    assert segments_of(df.limit(0), model).count() == 0


def test_sentence_places():
    text = "One two. Three?\n\n12 34. Four"
    assert [text[a:z] for a, z in sentence_places(text)] == ["One two.", "Three?", "Four"] and len(sentences_of(text)) == 3 and sentence_places("") == []


def test_label_codes(spark):
    labels = ["EN", "en-GB", "en_GB", "English", "eng", "ara", "und", "", None, "ur", "xx"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert [r[0] for r in df.select(label_code(df["label"])).collect()] == ["en"] * 5 + ["ar"] + [None] * 5


def test_mixture_never_loses_likelihood():
    r = np.random.default_rng(0)
    for _ in range(50):
        scores = r.normal(0, 20, (6, 5))
        chosen, post = mixture(scores, 8.0)
        assert np.allclose(post.sum(axis=1), 1) and len(set(chosen)) == len(chosen)
        assert set(chosen) - {int(scores.sum(axis=0).argmax())} <= set(scores.argmax(axis=1))


def test_window_prints_and_blocks():
    codes = word_codes(" ".join(f"w{i % 31}" for i in range(80)), {})
    for words in (12, 24, 80):
        (prints,) = window_prints(codes, words)
        assert len(prints) == 81 - words and all(window_prints(codes[i : i + words], words)[0][0] == prints[i] for i in (0, (80 - words) // 2, 80 - words))
    assert [len(x) for x in window_prints(codes[:0], 12, 24)] == [0, 0] and len(window_prints(codes[:1], 1)[0]) == 1
    masks = block_masks(2)
    assert len(masks) == 3 and sum(mask << shift for shift, mask in masks) == (1 << 64) - 1
    assert weighted_similarity(codes[:12], codes[:12]) == 1.0
    assert item_places(60, 12, (24, 48)) == [(12, k) for k in range(49)] + [(48, 0), (48, 12)] and item_places(11, 12, (24,)) == []


def test_near_passages(spark):
    """Recall of passages of 48 words of which some are changed: exact ones by any run of 12 words, others by fingerprints."""
    r = random.Random(4)
    vocabulary = [f"word{chr(97 + i % 26)}{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=48))) for i in range(100)]
    docs, changed = [], {1: 1, 2: 4}
    for kind, n in changed.items():
        for i, text in items:
            words = text.split()
            for at in (range(47) if n == 0 else [r.randrange(20, 28)] if n == 1 else (8, 19, 30, 41)):
                words[at] = "other" + str(at)
            docs.append((1000 * kind + i, " ".join(r.choices(vocabulary, k=30) + words + r.choices(vocabulary, k=30))))
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    got = {kind: [x for x in found.collect() if x["doc_id"] // 1000 == kind and x["doc_id"] % 1000 == x["item_id"]] for kind in changed}
    assert len(got[1]) == 100 and all(x["exact"] for x in got[1])
    assert found.where("doc_id % 1000 <> item_id").isEmpty() and not any(x["exact"] for x in got[2])


def test_find_leaks(spark):
    r = random.Random(2)
    vocabulary = [f"word{chr(97 + i % 26)}{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=30))) for i in range(40)] + [(98, None), (99, "too short")]
    docs = []
    for d in range(200):
        words = r.choices(vocabulary, k=r.choice([3, 40, 90]))
        if d % 3 == 0:
            n = r.choice([10, 11, 12, 13, 25])
            at = r.randrange(0, 30 - n)
            words[2:2] = [w.upper() if r.random() < 0.3 else w for w in items[d % 40][1].split()[at : at + n]]
        docs.append((d, r.choice([" ", ", ", "\n> "]).join(words), "n", "s"))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "a " * 50_000, None, None), (1003, docs[0][1], None, None)]
    found = find_leaks(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id int, text string"))
    want = set()
    for d, t, *_ in docs:
        w = words_of(t)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, x in items if any(tuple(words_of(x)[k : k + 12]) in grams for k in range(len(words_of(x)) - 11))}
    assert set(rows(found.where("exact"), "doc_id", "item_id")) == want and want
    assert find_leaks(spark.createDataFrame(docs, TEXT).limit(0), spark.createDataFrame(items, "item_id int, text string")).count() == 0
    assert find_leaks(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id int, text string").limit(0)).count() == 0
