"""Terms in texts (T7, T8): whole words with the inflections of their script, in the matching form of both.

A vocabulary is an index by the first letters of its terms, so a text's work grows with its words and not with the number
of terms.  Columns come as Arrow functions, as the matching form needs Unicode normal forms anyway.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tidewatch.functions.text import fold_text

# What may stand before and after a word of each script without changing it.
ARABIC_BEFORE = "[وفبلك]{0,2}(?:ال|لل)?"
ARABIC_AFTER = "يه يين يون يان ي ون ين ات ان ه ها هم هما هن كم نا".split()
ARABIC_FEMININE = "ه ات ت".split()
LATIN_AFTER = "s es 's i is n en e ite ites ien iens ienne iennes isch ische ischen í íes".split()
CYRILLIC_AFTER = 4  # letters of any ending

_ARABIC, _CYRILLIC, _WORDLESS = re.compile("[؀-ۿ]"), re.compile("[Ѐ-ӿ]"), re.compile("[぀-ヿ一-鿿]")
_START = re.compile(r"(?<!\w)\w")
_HEAD = 3


@lru_cache(50_000)
def core_of(term: str) -> str:
    """A term's matching form; an Arabic one without its article."""
    form = fold_text(term)
    return form[2:] if _ARABIC.search(form) and form.startswith("ال") and len(form) > 4 else form


@lru_cache(50_000)
def term_pattern(term: str) -> re.Pattern[str]:
    """A regular expression for a term in texts of the matching form."""
    core = core_of(term)
    body = r"\s+".join(re.escape(w) for w in core.split())
    if _ARABIC.search(core):
        if core.endswith("ه") and len(core) > 3 and " " not in core:  # a feminine ending and its plural
            body = re.escape(core[:-1]) + f"(?:{'|'.join(ARABIC_FEMININE)})"
        return re.compile(rf"(?<!\w){ARABIC_BEFORE}{body}(?:{'|'.join(ARABIC_AFTER)})?(?!\w)")
    if _CYRILLIC.search(core):
        return re.compile(rf"(?<!\w){body}\w{{0,{CYRILLIC_AFTER}}}(?!\w)")
    if _WORDLESS.search(core):
        return re.compile(body)
    return re.compile(rf"(?<!\w){body}(?:{'|'.join(map(re.escape, LATIN_AFTER))})?(?!\w)")


class TermIndex:
    """Terms by the first letters of their cores; ``find`` gives all occurrences of all terms."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.heads: dict[str, list[int]] = {}
        self.anywhere: list[int] = []
        for k, term in enumerate(terms):
            core = core_of(term)
            if not core:
                continue
            if _WORDLESS.search(core) or not re.match(r"\w", core):
                self.anywhere.append(k)
            else:
                # The last letter of a feminine ending may be another one in the text.
                self.heads.setdefault(core[: min(_HEAD, max(len(core) - 1, 1))], []).append(k)
        self.before = re.compile(ARABIC_BEFORE)

    def _cores(self, text: str, at: int) -> set[int]:
        """Where the core of a term may begin if a match begins at ``at``."""
        if not _ARABIC.match(text[at]):
            return {at}
        # What may stand before: up to two letters and then an article or none.
        out = {at}
        for n in range(3):
            if n and text[at + n - 1 : at + n] not in set("وفبلك"):
                break
            out.add(at + n)
            if text[at + n : at + n + 2] in ("ال", "لل"):
                out.add(at + n + 2)
        return out

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(term, start, end) in a text of the matching form."""
        out = []
        for k in self.anywhere:
            out += [(k, m.start(), m.end()) for m in term_pattern(self.terms[k]).finditer(text)]
        for word in _START.finditer(text):
            asked = {k for at in self._cores(text, word.start()) for n in range(1, _HEAD + 1) for k in self.heads.get(text[at : at + n], ())}
            for k in asked:
                if m := term_pattern(self.terms[k]).match(text, word.start()):
                    out.append((k, m.start(), m.end()))
        return out

    def counts(self, text: str) -> list[int]:
        """Occurrences of each term."""
        n = [0] * len(self.terms)
        for k, _, _ in self.find(text):
            n[k] += 1
        return n


@lru_cache(64)
def index_of(terms: tuple[str, ...]) -> TermIndex:
    return TermIndex(list(terms))


def class_hits(text: Column, classes: dict[str, list[str]]) -> Column:
    """For each class how many different terms of it stand in the text; an array in the order of the classes."""
    names, flat = list(classes), tuple(t for ts in classes.values() for t in ts)
    owner = [n for n, c in enumerate(names) for _ in classes[c]]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def hits(s: pd.Series) -> pd.Series:
        index = index_of(flat)

        def one(x: str | None) -> list[int]:
            out = [0] * len(names)
            for k in {k for k, _, _ in index.find(fold_text(x))}:
                out[owner[k]] += 1
            return out

        return s.map(one)

    return hits(text)


def hits(text: Column, terms: list[str]) -> Column:
    """How many different terms stand in the text."""
    return class_hits(text, {"": terms})[0]


def has_any(text: Column, terms: list[str]) -> Column:
    return hits(text, terms) > 0


def count_terms(text: Column, terms: list[str]) -> Column:
    """Occurrences of any of the terms."""

    @F.pandas_udf(T.IntegerType())
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sum(index_of(tuple(terms)).counts(fold_text(x))))

    return count(text)
