"""Problem 10: one form for texts that look the same.

``normal_form`` is the named method: compatibility normalisation in composed form, full case folding, mapped white
space and removal of default-ignorable characters, with look-alike letters mapped to one of them.  It merges texts
that look different as well (case, raised and circled digits, joiners between letters that would connect), so it serves
as the key under which candidates meet and as the form for comparisons elsewhere; ``visual_form`` keeps those apart and
decides.  A text's form is that of its words, and each distinct word is normalised once.

Defined results: null stays null and pairs with nothing; '' is a text like any other; accents count in whatever way
they are composed; digits of different scripts count unless their shapes are the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import cut

# Letters of other scripts by the Latin letter of the same shape.
LOOK_ALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "ϹС", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО",
    "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "a": "а", "c": "ϲс", "d": "ԁ", "e": "е", "h": "һ",
    "i": "і", "j": "јϳ", "o": "οо", "p": "ρр", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "П": "Π", "Г": "Γ", "Ф": "Φ",
}
# Persian digits that have the shape of the Arabic digit of the same value, and letters likewise.
SAME_SHAPE = dict(zip("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩"))
# Unicode's default-ignorable ranges.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]


# Kinds of compatible characters that look different from what they stand for.
DIFFERENT_SHAPE = {"<super>", "<sub>", "<circle>", "<fraction>"}
# Arabic letters that never connect to the next one, after which a joiner has no effect.
RIGHT_JOINING = "اآأإٱدذرزژڈڑوؤةۀەءے"
#: A zero-width non-joiner that keeps two letters apart which would connect.
_APART = re.compile(rf"(?<=[ؠ-يٮ-ۓ])(?<![{RIGHT_JOINING}])\u200c(?=[ؠ-يٮ-ۓ])")
_JOINER = "\u200c"


@cache
def _drop() -> dict[int, None]:
    return {c: None for a, b in IGNORABLE for c in range(a, b + 1) if chr(c) != _JOINER}


@cache
def _shapes() -> dict[int, str]:
    table = {ord(x): latin for latin, xs in LOOK_ALIKES.items() for x in xs}
    return table | {ord(a): b for a, b in SAME_SHAPE.items()}


def _compatible(text: str) -> str:
    """Compatibility normalisation with look-alike letters mapped.

    They are mapped before and after decomposing: some have another letter as their compatible form, and some stand
    below an accent.
    """
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", text.translate(_drop()).translate(_shapes())).translate(_shapes()))


@cache
def _keeps_shape(c: str) -> bool:
    return unicodedata.decomposition(c).partition(" ")[0] in DIFFERENT_SHAPE


def _seen_word(word: str) -> str:
    if any(map(_keeps_shape, word)):
        word = "".join(part if kept else _compatible(part) for kept, part in ((k, "".join(cs)) for k, cs in groupby(word, _keeps_shape)))
    else:
        word = _compatible(word)
    # A joiner stays where its letters, in the form they have now, would connect without it.
    return _JOINER.join(part.replace(_JOINER, "") for part in _APART.split(word)) if _JOINER in word else word


def _normal_word(word: str) -> str:
    return unicodedata.normalize("NFKC", _compatible(word.replace(_JOINER, "")).casefold())


_short_seen, _short_normal = lru_cache(300_000)(_seen_word), lru_cache(300_000)(_normal_word)


def _by_word(text: str, short, long) -> str:
    """The words' forms; words of more than 64 characters aren't remembered.  A form may hold spaces, or be empty."""
    return " ".join(" ".join(w if w.isascii() and short is _short_seen else short(w) if len(w) <= 64 else long(w) for w in text.split()).split())


def visual_form(text: str | None) -> str | None:
    """Texts that look the same to one text, keeping what the eye tells apart (case, accents, digits)."""
    if text is None:
        return None
    return " ".join(text.split()) if text.isascii() else _by_word(text, _short_seen, _seen_word)


def normal_form(text: str | None) -> str | None:
    """The one form for comparisons: ``visual_form`` with full case folding and without any joiner or raised form."""
    seen = visual_form(text)
    return seen if seen is None else seen.casefold() if seen.isascii() else _by_word(seen, _short_normal, _normal_word)


@cache
def _cases() -> dict[int, str]:
    """Lower-case letters whose capitals look alike: Cyrillic v and b, as their capitals are the same shape."""
    pairs = {x.casefold(): latin.casefold() for latin, xs in LOOK_ALIKES.items() for x in xs}
    return {ord(a): b for a, b in pairs.items() if len(a) == 1 and a not in "νi"}


def comparable_form(text: str | None) -> str | None:
    """``normal_form`` in which a text and its upper case are equal in every script, for comparing words."""
    form = normal_form(text)
    return form if form is None or form.isascii() else form.translate(_cases())


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        codes, texts = pd.factorize(b["text"])
        seen = [visual_form(t) for t in texts]
        prints = [(xxhash.xxh3_128_digest(normal_form(s)), xxhash.xxh3_128_digest(s), xxhash.xxh3_128_digest(t)) for s, t in zip(seen, texts)]
        rows = codes >= 0
        out = pd.DataFrame(prints, columns=["normal", "seen", "raw"], dtype=object).take(codes[rows])
        yield out.assign(doc_id=b["doc_id"][rows].to_numpy())[["doc_id", "normal", "seen", "raw"]]


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        codes, texts = pd.factorize(b["text"])
        forms = pd.Series([normal_form(t) for t in texts] + [None], dtype=object)
        yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "form": forms.to_numpy()[codes]})


def normalise(documents: DataFrame) -> DataFrame:
    """(doc_id, form): every text in the one form for comparisons."""
    return documents.select("doc_id", "text").mapInPandas(_normalise, "doc_id long, form string")


def look_alike_pairs(documents: DataFrame, salts: int = 16) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts look the same but differ in characters.

    Texts are read once, and only fingerprints go on.  Candidates meet under the normal form as classes of equal texts,
    counted before they are shuffled; classes whose form looks the same make pairs, and only then their documents: copies
    of one text never meet each other.  The documents of the larger class of a pair are spread over ``salts``.
    """
    prints = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_prints, "doc_id long, normal binary, seen binary, raw binary"))
    classes = prints.groupBy("normal", "seen", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = classes.groupBy("normal").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("normal")
    classes = cut(classes.join(several, "normal", "left_semi"))
    size = F.struct("n", "raw").alias("size")
    large, small = classes.select("normal", "seen", "raw", size), classes.select("normal", "seen", F.col("raw").alias("raw_b"), F.col("n").alias("n_b"))
    met = large.join(small, ["normal", "seen"]).where(F.col("size") > F.struct("n_b", "raw_b")).select("raw", "raw_b")
    # Documents of classes in pairs: first those of the smaller class, then, spread, those of the larger one.
    few = met.join(prints.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("doc_id_b")), "raw_b").select("raw", "doc_id_b")
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = prints.select("raw", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    pairs = many.join(few, ["raw", "salt"]).where("doc_id <> doc_id_b")
    return pairs.select(F.least("doc_id", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id", "doc_id_b").alias("doc_id_b")).distinct()
