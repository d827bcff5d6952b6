"""Problem 4: the languages a text is written in.

Character n-gram models are fitted on a bounded sample of labelled rows, and then on that sample's sentences as the
models themselves label them, since labels are wrong at times.  For a text, expectation-maximisation estimates the
proportions of the languages from the likelihoods of its sentences; languages enter one by one, as long as the
log-likelihood gains more than ``penalty``.  Each sentence then has a language, and each language a confidence.

Words are scored once and remembered, so a batch is a lookup and a sum per sentence.  Where all sentences have the
same best language no other proportion has a higher likelihood, so no iterations are needed there.

Sentences count whatever their length: a short one differs little in likelihood, which the penalty outweighs.

Defined results: texts without words, null and '' have no language; a tie goes to the first language in the model's order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LANGUAGES = ("en", "ar", "fr", "de", "es", "tr", "fa", "ru")
# Other notations of a language label.
NOTATIONS = {
    "en": "eng english", "ar": "ara arabic", "fr": "fra fre french", "de": "deu ger german", "es": "spa spanish",
    "tr": "tur turkish", "fa": "fas per persian farsi", "ru": "rus russian",
}
_WORD = re.compile(r"[^\W\d_]+(?:[‌'’ً-ْ̀-ͯ]+[^\W\d_]+)*")
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = "assoc auth bd comm dept dev dir dr etc gen mr mrs nr prof synd un vs".split()
_NO_END = "".join(rf"(?<!\b{a}\.)" for a in ABBREVIATIONS)
#: Ends of sentences: not after an initial or an abbreviation.
_END = re.compile(rf"(?<=[.!?؟。…])(?<!\s\w\.){_NO_END}[\"'”»)\]]*[^\S\n]+|\n+", re.IGNORECASE)


def label_code(label: Column) -> Column:
    """The two-letter code of a label in any notation; null if it names none of the languages."""
    bare = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    known = {n: code for code, names in NOTATIONS.items() for n in [code, *names.split()]}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), bare)


#: Tags, handles and addresses are words of no language.
_MARKS = re.compile(r"[#@][\w-]+|https?://\S+")


def _words(sentence: str) -> list[str]:
    return _WORD.findall(_MARKS.sub(" ", sentence.lower()))


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence, in lower case."""
    return [w for s in _END.split(text) if (w := _words(s))]


def sentence_places(text: str) -> list[tuple[int, int]]:
    """Where each sentence of ``sentences_of`` begins and ends."""
    cuts = [0, *(x for m in _END.finditer(text) for x in m.span()), len(text)]
    return [(a, z) for a, z in zip(cuts[::2], cuts[1::2]) if _words(text[a:z])]


class NgramModel:
    """Interpolated character trigrams of several languages; scores words as vectors of log-likelihoods."""

    def __init__(self, words: list[Counter], weight: float = 3.0):
        grams = [[Counter(), Counter(), Counter()] for _ in words]
        for counts, tables in zip(words, grams):
            for word, n in counts.items():
                padded = f"^{word}$"
                for i in range(1, len(padded)):
                    for k in (1, 2, 3):
                        if i - k + 1 >= 0:
                            tables[k - 1][padded[i - k + 1 : i + 1]] += n
        chars = {g for t in grams for g in t[0]}
        self.rows: dict[str, int] = {}
        table: list[list[float]] = [[math.log(0.5 / (sum(t[0].values()) + len(chars) + 1)) for t in grams]]
        context = [[Counter() for _ in range(2)] for _ in words]
        for t, c in zip(grams, context):
            for k in (1, 2):
                for g, n in t[k].items():
                    c[k - 1][g[:-1]] += n

        def p(lang: int, g: str) -> float:
            t, c = grams[lang], context[lang]
            out = (t[0][g[-1]] + 0.5) / (sum_[lang] + len(chars) + 1)
            for k in range(2, len(g) + 1):
                part = g[-k:]
                out = (t[k - 1][part] + weight * out) / (c[k - 2][part[:-1]] + weight)
            return out

        sum_ = [sum(t[0].values()) for t in grams]
        for k in range(3):
            for g in sorted({g for t in grams for g in t[k]}):
                self.rows[g] = len(table)
                table.append([math.log(p(lang, g)) for lang in range(len(words))])
        self.table = np.array(table, dtype=np.float32)

    def score(self, word: str) -> np.ndarray:
        padded, rows = f"^{word}$", []
        get = self.rows.get
        for i in range(1, len(padded)):
            at = get(padded[max(0, i - 2) : i + 1])
            if at is None:
                at = get(padded[i - 1 : i + 1])
                if at is None:
                    at = get(padded[i], 0)
            rows.append(at)
        return self.table[rows].sum(axis=0)


def fit(sample: list[tuple[str, str]], rounds: int = 2, clear: float = 1.5) -> NgramModel:
    """A model from (text, label code); labels start the fit, then every sentence takes its own best language.

    A sentence that contradicts its label by less than ``clear`` per word, such as one with a foreign name, is left out.
    """
    parts = [(LANGUAGES.index(code), s) for text, code in sample for s in sentences_of(text)]
    model = None
    for _ in range(rounds):
        words = [Counter() for _ in LANGUAGES]
        known: dict[str, np.ndarray] = {}
        for lang, sentence in parts:
            if model is not None:
                for w in sentence:
                    if w not in known:
                        known[w] = model.score(w)
                score = sum(known[w] for w in sentence)
                best = int(score.argmax())
                if best != lang and score[best] - score[lang] < clear * len(sentence):
                    continue
                lang = best
            words[lang].update(sentence)
        model = NgramModel(words)
    return model


def mixture(scores: np.ndarray, penalty: float, steps: int = 20) -> tuple[list[int], np.ndarray]:
    """Languages of a text, and the posterior of each of its sentences, from the sentences' log-likelihoods.

    The languages that may enter are those that are best for some sentence.  No mixture is likelier than every sentence
    in its best language, so where that gains no more than ``penalty`` nothing is iterated.
    """
    chosen = [int(scores.sum(axis=0).argmax())]
    best = float(scores[:, chosen[0]].sum())
    most = float(scores.max(axis=1).sum())
    able = sorted(set(scores.argmax(axis=1).tolist()))
    post = np.ones((len(scores), 1))
    while most - best > penalty:
        options = [(*_em(scores[:, [*chosen, k]], steps), k) for k in able if k not in chosen]
        if not options:
            break
        value, now, k = max(options, key=lambda o: (o[0], -o[2]))
        if value - best <= penalty:
            break
        chosen.append(k)
        best, post = value, now
    return chosen, post


def _em(scores: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
    n, k = scores.shape
    share = np.full(k, 1.0 / k)
    top = scores.max(axis=1)
    like = np.exp(scores - top[:, None])
    for _ in range(steps):
        joint = like * share
        whole = joint.sum(axis=1)
        post = joint / whole[:, None]
        new = np.maximum(post.sum(axis=0) / n, 1e-9)
        if abs(new[0] - share[0]) < 1e-6 and k == 2:
            break
        share = new
    return float(np.log(whole).sum() + top.sum()), post


class _Scorer:
    """Sentences' log-likelihoods per language; words are scored once and remembered, up to a limit."""

    def __init__(self, model: NgramModel, temper: float, most: int = 300_000):
        self.model, self.temper, self.most = model, temper, most
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.vectors = np.zeros((1 << 12, len(LANGUAGES)), dtype=np.float32)

    def score(self, texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, scores, lengths) of every text with sentences."""
        if len(self.ids) > self.most:
            self.forget()
        flat: list[int] = []
        starts: list[int] = []
        owners: list[int] = []
        ids = self.ids
        for row, text in enumerate(texts):
            for sentence in sentences_of(text):
                starts.append(len(flat))
                owners.append(row)
                for w in sentence:
                    at = ids.get(w)
                    if at is None:
                        ids[w] = at = len(ids)
                        if at >= len(self.vectors):
                            self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
                        self.vectors[at] = self.model.score(w)
                    flat.append(at)
        if not starts:
            return
        scores = np.add.reduceat(self.vectors[np.array(flat)], np.array(starts), axis=0).astype(np.float64) * self.temper
        lengths, owner = np.diff([*starts, len(flat)]), np.array(owners)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for a, z in zip(first, np.r_[first[1:], len(owner)]):
            yield int(owner[a]), scores[a:z], lengths[a:z]


def _sure(scores: np.ndarray) -> tuple[list[int], np.ndarray] | None:
    """The only language and its posterior for each sentence, where all sentences have the same best one."""
    top = scores.argmax(axis=1)
    return ([int(top[0])], np.full((len(scores), 1), _posterior(scores.sum(axis=0), int(top[0])))) if (top == top[0]).all() else None


def _detect(shared, penalty: float, temper: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value, temper)
        for b in batches:
            out = []
            for row, scores, lengths in scorer.score(b["text"]):
                chosen, post = _sure(scores) or mixture(scores, penalty)
                mine = post.argmax(axis=1)
                used = [k for k in range(len(chosen)) if (mine == k).any()]
                main = max(used, key=lambda k: (float(lengths[mine == k].sum()), -k))
                for k in used:
                    out.append((row, LANGUAGES[chosen[k]], float(post[mine == k, k].mean()), k == main, int((mine == k).sum()), len(used) > 1))
            frame = pd.DataFrame(out, columns=["row", "language", "confidence", "main", "sentences", "several"])
            at = frame.pop("row").to_numpy(dtype=int)
            for c in ("table_name", "row_id", "label"):
                frame[c] = b[c].to_numpy()[at]
            yield frame[["table_name", "row_id", "label", "language", "confidence", "main", "sentences", "several"]]

    return run


def _cut_up(shared, penalty: float, temper: float):
    """Neighbouring sentences of one language as one segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value, temper)
        for b in batches:
            names, ids, texts = (b[c].tolist() for c in ("table_name", "row_id", "text"))
            out = []
            for row, scores, lengths in scorer.score(b["text"]):
                chosen, post = _sure(scores) or mixture(scores, penalty)
                mine, places = post.argmax(axis=1), sentence_places(texts[row])
                borders = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1), len(mine)]
                for n, (i, j) in enumerate(zip(borders, borders[1:]), 1):
                    sure = float(np.average(post[i:j, mine[i]], weights=lengths[i:j]))
                    out.append((names[row], ids[row], n, places[i][0], places[j - 1][1], LANGUAGES[chosen[mine[i]]], sure))
            yield pd.DataFrame(out, columns=["table_name", "row_id", "segment", "start", "stop", "language", "confidence"])

    return run


def _posterior(total: np.ndarray, lang: int) -> float:
    return float(1.0 / np.exp(total - total[lang]).sum())


def bounded_sample(rows: DataFrame, columns: list[str], most: int) -> list[tuple]:
    """At most ``most`` rows, those with the lowest hash of ``text``; about one and a half times as many leave the tasks."""
    n = rows.count()
    share = min(1.0, 1.5 * most / max(n, 1))
    h = F.xxhash64("text")
    few = rows.where(F.pmod(h, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) + 1)) if share < 1 else rows
    return [tuple(r) for r in few.orderBy(F.pmod(h, F.lit(1 << 40)), *columns).select(*columns).limit(most).collect()]


def fit_on(rows: DataFrame, sample_rows: int = 6000) -> NgramModel:
    """A model from at most ``sample_rows`` labelled rows (text, code), those with the lowest hash of their text."""
    labelled = rows.where(F.col("code").isNotNull() & (F.length("text") > 0)).select("text", "code")
    return fit(bounded_sample(labelled, ["text", "code"], sample_rows))


def languages_of(rows: DataFrame, model: NgramModel, penalty: float = 8.0, temper: float = 0.5) -> DataFrame:
    """(table_name, row_id, label, language, confidence, main, sentences, several): one row per language of each text.

    ``rows``: table_name, row_id, label, text.  ``temper`` flattens the likelihoods, as neighbouring n-grams depend on
    each other.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    texts = rows.select("table_name", F.col("row_id").cast("long").alias("row_id"), "label", "text").where(F.length("text") > 0)
    schema = "table_name string, row_id long, label string, language string, confidence double, main boolean, sentences int, several boolean"
    return texts.mapInPandas(_detect(shared, penalty, temper), schema)


def segments_of(rows: DataFrame, model: NgramModel, penalty: float = 8.0, temper: float = 0.5) -> DataFrame:
    """(table_name, row_id, segment, start, stop, language, confidence): the stretches of each text in one language.

    ``start`` and ``stop`` count characters from 0, ``stop`` exclusive; a stretch ends with a sentence.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    texts = rows.select("table_name", F.col("row_id").cast("long").alias("row_id"), "text").where(F.length("text") > 0)
    return texts.mapInPandas(_cut_up(shared, penalty, temper), "table_name string, row_id long, segment int, start int, stop int, language string, confidence double")


def mislabelled(found: DataFrame) -> DataFrame:
    """The rows of ``languages_of`` of texts whose label is missing, meaningless or wrong, or that mix languages.

    A text's rows are made together and say whether there are several, so nothing is shuffled.
    """
    wrong = F.coalesce(label_code(F.col("label")) != F.col("language"), F.lit(True))
    return found.where(F.col("several") | wrong)
