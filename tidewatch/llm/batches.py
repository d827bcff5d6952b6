"""Problem 2: duplicates of new batches against all accepted history.

Sorted neighbourhoods of several keys over persisted runs.  A record has a key for its page, one for the whole record,
and marks; the neighbourhood is every record of an equal key.  A mark is a hash of the headline's words with digits and
of ten words of the text, chosen by winnowing, so that two texts with ``RUN`` words in a row in common share one.  What
``same_report`` accepts shares a page, a mark or the whole record, so no bound on the neighbours is needed, and windows
over the order of headlines could meet nothing else.

Keys are hashes of one length with their kind in the last bits.  Accepted keys lie in runs, cut into ranges of equal width
and sorted within them, each range in one bucket of its run.  A batch is cut at the same bounds and merged only with the
ranges that its keys fall into: the other buckets aren't read and none is shuffled.  Texts lie in buckets by id; only the
buckets of records that were met are read, and of those only the headlines until two of them agree.  Batches that wait
together are merged in one go: a record meets what was accepted before it, by batch and id, so the result is that of one
batch after the other.  When ``fan`` runs of one order of size are there, they become one (each record is rewritten once
per order of size); when the ranges have grown to twice ``range_rows`` that merge takes all runs and cuts new ones.

Copies to the letter and records of one page need their first record only, so those groups never become pairs, and
copies leave no marks: a group of copies that holds a third of all rows costs a row each.

Defined results: records without page, headline and text are no duplicates of anything; without text, a headline with
a number and five words is enough, without headline a text of 32 words in a row, or the same text of eight words; a
record repeated under the same batch and id counts once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain
from urllib.parse import parse_qsl, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.forms import comparable_form
from tidewatch.llm.names import SPELLINGS, typing_errors
from tidewatch.session import cut, scratch_path

_WORD = re.compile(r"[^\W_]+")
# Parameters of an address that only say where a reader came from.
TRACKING = re.compile(r"^(?:utm_.*|fbclid|gclid|ref|igshid|mc_cid|mc_eid|yclid|spm)$")
#: Words in a row that two texts of one report share: with headlines, and where one has none; of headlines without text.
RUN, RUN_BARE, RUN_LINE = 12, 32, 4
# Words of a mark: the more, the fewer texts of different reports share one, and the more marks there are.
_GRAM, _GRAM_BARE, _GRAM_LINE = 10, 16, 3
TEXTLESS, BARE = 1, 2  # flags of a key's record
PAGE, COPY, TEXT, ALONE, LINE = range(5)  # kinds of keys, in their last three bits


def page_of(url: str | None) -> str:
    """The page an address leads to, without scheme, port, mirror hosts, AMP, tracking, order of parameters, fragment."""
    if not url or not url.strip():
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return ""
    host = re.sub(r"^(?:www\.|m\.|amp\.)+", "", host)
    path = re.sub(r"(?:/amp)?/*$", "", re.sub(r"/{2,}", "/", parts.path))
    kept = sorted((k, v) for k, v in parse_qsl(parts.query) if not TRACKING.match(k))
    return f"{host}{path}?{kept}" if host and (path or kept) else ""


@lru_cache(200_000)
def has_digit(word: str) -> bool:
    return any(c.isdigit() for c in word)


def headline_words(title: str | None, words: Words | None = None) -> tuple[list[str], list[str]]:
    """The words of a headline without a leading mark (``UPDATE:``) and a trailing publisher, and all its words."""
    seen = (words or Words()).seen(title).strip("“”\"'«»„ ")
    whole = _WORD.findall(seen)
    seen = re.sub(r"^[\W_]*(?:[^\W\d_]+ ?){1,2} ?[:|] +", "", seen)
    cut_at = re.match(r"^(.*\S) +[-–—|] +((?:[^\s\d]+ ?){1,4})$", seen.rstrip("“”\"'«»! "))
    if cut_at and len(_WORD.findall(cut_at[1])) >= 3:
        seen = cut_at[1]
    return _WORD.findall(seen), whole


class Words:
    """Words of texts with a code each; remembers white-space-separated tokens between texts, as a form is that of its tokens."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.codes: list[int] = []
        self.tokens: dict[str, tuple[bool, str, str, tuple[int, ...]]] = {}

    def number(self, word: str) -> int:
        if (i := self.ids.get(word)) is None:
            i = self.ids[word] = len(self.codes)
            self.codes.append(xxhash.xxh3_64_intdigest(word))
        return i

    def token(self, token: str) -> tuple[bool, str, str, tuple[int, ...]]:
        """Whether anything is left of it, its form, its words, and their numbers."""
        form = comparable_form(token)
        seen = form.translate(SPELLINGS)
        words = _WORD.findall(seen)
        known = self.tokens[token] = (form != "", seen, " ".join(words), tuple(map(self.number, words)))
        return known

    def _parts(self, text: str | None) -> list[tuple[bool, str, str, tuple[int, ...]]]:
        get, token = self.tokens.get, self.token
        return [get(t) or token(t) for t in (text or "").split()]

    def seen(self, text: str | None) -> str:
        """The form of a text for comparing words."""
        return " ".join([seen for left, seen, *_ in self._parts(text) if left])

    def of_text(self, text: str | None) -> tuple[str, list[int]]:
        """The words of a text without a leading ``(publisher) -``, and their numbers."""
        parts = self._parts(text)
        if next((seen.startswith("(") for left, seen, *_ in parts if left), False):
            words = _WORD.findall(re.sub(r"^\([^)]{1,60}\) *[-–—:] *", "", self.seen(text)))
            return " ".join(words), list(map(self.number, words))
        return " ".join([x[2] for x in parts if x[2]]), list(chain.from_iterable([x[3] for x in parts]))

    def forget(self) -> None:
        """Empties what has grown large; numbers given before are void."""
        if len(self.tokens) + len(self.ids) > 400_000:
            self.__init__()


def text_words(text: str | None) -> list[str]:
    """The words of a text without a leading ``(publisher) -``."""
    return Words().of_text(text)[0].split()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(codes) - n + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n if len(out) else 0):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_codes(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """64-bit codes of the runs of ``n`` words; ``known`` remembers words between calls."""
    return _grams(np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], dtype=np.uint64), n)


def winnow(codes: np.ndarray, gram: int, run: int) -> list[int]:
    """Of runs of ``gram`` words the least of every ``run - gram + 1`` in a row: texts with ``run`` words in common share one."""
    w = min(run - gram + 1, len(codes))
    return np.unique(np.lib.stride_tricks.sliding_window_view(codes, w).min(axis=1)).tolist() if w > 0 else []


def winnow_all(codes: np.ndarray, lengths: np.ndarray, gram: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """``winnow`` of many texts, whose words' codes follow one another: the texts' numbers and values; none of texts below ``run`` words."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    grams, starts = _grams(codes, gram), np.flatnonzero(left >= run)
    least = grams[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    for i in range(1, run - gram + 1 if len(starts) else 0):
        least = np.minimum(least, grams[starts + i])
    owner = np.repeat(np.arange(len(lengths)), lengths)[starts]
    order = np.lexsort((least, owner))
    owner, least = owner[order], least[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    return owner[new], least[new]


def blocks_of(headline: list[str], whole: list[str]) -> list[str]:
    """The words with digits of a headline and of all its words, in their order: equal for one of each in one report."""
    return list(dict.fromkeys(" ".join(filter(has_digit, x)) for x in ((headline,) if headline == whole else (headline, whole)))) if headline else []


def _code(text: str) -> str:
    return f"{xxhash.xxh3_64_intdigest(text):016x}"


def _bounded(stem: str, tail: str, most: int = 400) -> str:
    """An order key of at most ``most`` characters: a longer stem keeps its beginning and a hash of the whole before the tail."""
    if len(stem) + len(tail) > most:
        stem = f"{stem[: most - len(tail) - 17]}#{_code(stem)}"
    return stem + tail


def order_keys(headline: list[str], text: str) -> list[str]:
    """The headline from both ends, each followed by a hash of the text: equal ones stand together."""
    tail = f"|{_code(text)}"
    return [_bounded(f"o{' '.join(headline)}", tail), _bounded(f"p{' '.join(reversed(headline))}", tail)] if len(headline) >= 3 else []


def tells(headline: list[str]) -> bool:
    """Whether a headline tells reports apart without text."""
    return len(headline) >= 5 and any(map(has_digit, headline))


def _key(values: np.ndarray, kind: int) -> np.ndarray:
    return ((_mixed(values) & ~np.uint64(7)) | np.uint64(kind)).view(np.int64)


def marks_of(heads: list[tuple[list[str], list[str]]], bodies: list[tuple[str, list[int]]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Marks of many records: the records' numbers, ascending, and keys of headline's numbers and text, text alone, headline alone."""
    lines = [(i, list(map(words.number, h))) for i, (head, whole) in enumerate(heads) if tells(head) for h in ([head] if head == whole else [head, whole])]
    table = np.array(words.codes, dtype=np.uint64)
    blocks = [blocks_of(*h) for h in heads]
    with_block = [np.array([len(b) > n for b in blocks], dtype=bool) for n in (0, 1)]
    block = [np.array([xxhash.xxh3_64_intdigest(b[n]) if len(b) > n else 0 for b in blocks], dtype=np.uint64) for n in (0, 1)]

    def joined(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(list(map(len, texts)), dtype=np.int64)
        return table[np.fromiter(chain.from_iterable(texts), np.int64, int(lengths.sum()))], lengths

    def short(least: int, run: int) -> tuple[np.ndarray, np.ndarray]:
        at = [i for i, (_, x) in enumerate(bodies) if least <= len(x) < run]
        return np.array(at, dtype=np.int64), np.array([xxhash.xxh3_64_intdigest(bodies[i][0]) for i in at], dtype=np.uint64)

    out: list[tuple[np.ndarray, np.ndarray]] = []

    def beside_blocks(owner: np.ndarray, values: np.ndarray, kind: int) -> None:
        for there, code in zip(with_block, block):
            own = owner[there[owner]]
            with np.errstate(over="ignore"):
                out.append((own, _key(_mixed(values[there[owner]]) + code[own], kind)))

    texts = joined([x for _, x in bodies])
    beside_blocks(*winnow_all(*texts, _GRAM, RUN), TEXT)
    beside_blocks(*short(1, RUN), TEXT)
    for owner, values in (winnow_all(*texts, _GRAM_BARE, RUN_BARE), short(8, RUN_BARE)):
        out.append((owner, _key(values, ALONE)))
    owner, values = winnow_all(*joined([x for _, x in lines]), _GRAM_LINE, RUN_LINE)
    beside_blocks(np.array([i for i, _ in lines], dtype=np.int64)[owner], values, LINE)
    owner, key = (np.concatenate(x) for x in zip(*out))
    once = pd.DataFrame({"owner": owner, "key": key}).drop_duplicates().sort_values("owner", kind="stable")
    return once["owner"].to_numpy(), once["key"].to_numpy()


def mark_keys(headline: list[str], whole: list[str], body: list[str], known: dict[str, int]) -> list[int]:
    """The marks of one record."""
    words = Words()
    return marks_of([(headline, whole)], [(" ".join(body), list(map(words.number, body)))], words)[1].tolist()


def _slip(a: str, b: str) -> bool:
    """Whether b is a with one typing error in it."""
    return not (any(c.isdigit() for c in a + b)) and min(len(a), len(b)) >= 2 and max(len(a), len(b)) >= 3 and typing_errors(a, b, 1) <= 1


def same_but_for_slips(a: list[str], b: list[str], loose_ends: int = 0, shortened: bool = False, run: int = 0) -> bool:
    """Whether two texts are the same but for typing errors and what one of them has more at an end.

    That is up to ``loose_ends`` words without numbers, or, where texts may be ``shortened``, all that follows or
    precedes a common part of 20 words or three fifths of the shorter text.  Texts that differ have ``run`` words in a
    row in common.
    """
    if a == b:
        return True
    if not a or not b:
        return False
    slips: Counter = Counter()
    common = added = longest = 0
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for n, (op, i, j, k, m) in enumerate(blocks):
        if op == "equal":
            common += j - i
            longest = max(longest, j - i)
            continue
        mine, theirs = list(a[i:j]), list(b[k:m])
        digits = any(map(has_digit, mine + theirs))
        if len(mine) == len(theirs) and all(_slip(x, y) for x, y in zip(mine, theirs)):
            slips.update(zip(mine, theirs))
            common += len(mine)
        elif mine and theirs and not digits and typing_errors("".join(mine), "".join(theirs), 1) <= 1:
            slips[" ".join(mine), " ".join(theirs)] += 1
            common += len(mine)
        elif n in (0, len(blocks) - 1) and max(len(mine), len(theirs)) <= loose_ends and not (mine and theirs) and not digits:
            continue
        elif shortened and not (mine and theirs) and len(mine) + len(theirs) <= 3 and not digits:
            added += 1  # a crosshead
        elif shortened and n in (0, len(blocks) - 1) and not (mine and theirs):
            continue
        else:
            return False
    if longest < run or shortened and common < min(20, 0.6 * min(len(a), len(b))):
        return False
    # The same change twice is a change of content, such as another place.
    return added <= 3 and all(n == 1 for n in slips.values()) and sum(slips.values()) <= max(2, len(a) // 5)


@lru_cache(20_000)
def _agree(a: str, whole_a: str, b: str, whole_b: str, run: int) -> bool:
    forms = dict.fromkeys((x, y) for x in (a, whole_a) for y in (b, whole_b))
    return any(same_but_for_slips(x.split(), y.split(), 4, run=run) for x, y in forms)


def same_so_far(a: dict, b: dict) -> bool | None:
    """Whether two records carry the same report by page and headline; None where their texts decide."""
    if a["page"] and a["page"] == b["page"]:
        return True
    text = not ((a["flag"] | b["flag"]) & TEXTLESS)
    if a["headline"] and b["headline"]:
        same = _agree(a["headline"], a["whole"], b["headline"], b["whole"], 0 if text else RUN_LINE)
        return (None if text else tells(a["headline"].split()) and tells(b["headline"].split())) if same else False
    return None if text else False


def same_text(a: list[str], b: list[str], headed: bool) -> bool:
    """Whether two texts are of the same report, if they stand under headlines that agree, or where one has none."""
    return (headed or len(a) >= 8) and same_but_for_slips(a, b, 8, shortened=True, run=RUN if headed else RUN_BARE)


def same_report(a: dict, b: dict) -> bool:
    """Whether two records (page, headline, whole, body: words after one another, flag) carry the same report."""
    same = same_so_far(a, b)
    return same_text(a["body"].split(), b["body"].split(), bool(a["headline"] and b["headline"])) if same is None else same


_HEAD = ("page", "headline", "whole", "flag")
_RECORD = "id long, batch int, page string, headline string, whole string, body string, flag int, sure array<long>, marks array<long>"


def _listed(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        words.forget()
        n, (urls, titles, texts) = b.num_rows, (b.column(c).to_pylist() for c in ("url", "title", "text"))
        pages, heads, bodies = list(map(page_of, urls)), [headline_words(x, words) for x in titles], list(map(words.of_text, texts))
        marks = _listed(*marks_of(heads, bodies, words), n) if n else pa.array([], pa.list_(pa.int64()))
        head, whole = ([" ".join(h[k]) for h in heads] for k in (0, 1))
        sure = []
        for i, (page, (h, _), (body, numbers)) in enumerate(zip(pages, heads, bodies)):
            if page:
                sure.append((i, xxhash.xxh3_64_intdigest(page), PAGE))
            if len(numbers) >= 8 or h and numbers or tells(h):
                sure.append((i, xxhash.xxh3_64_intdigest("\n".join((head[i], whole[i], body))), COPY))
        keys = [_key(np.array([x], dtype=np.uint64), kind)[0] for _, x, kind in sure]
        flags = pa.array([TEXTLESS * (not x) + BARE * (not h) for h, (_, x) in zip(head, bodies)], pa.int32())
        listed = _listed(np.array([i for i, *_ in sure], dtype=np.int64), np.array(keys, dtype=np.int64), n)
        strings = [pa.array(x, pa.string()) for x in (pages, head, whole, [x for x, _ in bodies])]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("batch"), *strings, flags, listed, marks], names=[f.split()[0] for f in _RECORD.split(", ")])


def describe(records: DataFrame) -> DataFrame:
    """Records (id, batch, url, title, text) with what they are compared by."""
    return records.select(F.col("id").cast("long").alias("id"), F.col("batch").cast("int").alias("batch"), "url", "title", "text").mapInArrow(_describe, _RECORD)


def spread(records: DataFrame) -> DataFrame:
    """Records once each, spread by id, as texts take Python time however few bytes they are."""
    return records.repartition(max(records.sparkSession.sparkContext.defaultParallelism, 8), "batch", "id").dropDuplicates(["batch", "id"])


def _pairs(last: int, most: int = 1 << 20):
    """Pairs (id, other) of one range of keys: each record of a batch after ``last`` with all before it that have an equal mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        key, batch, ids, flag = (rows[c].to_numpy() for c in ("key", "batch", "id", "flag"))
        # Most keys have one record; they leave before the full order is made.
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        order = order[np.lexsort((ids[order], batch[order], key[order]))]
        key, batch, ids, flag = key[order], batch[order], ids[order], flag[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        start = np.repeat(starts, np.diff(np.append(starts, len(key))))
        need = np.select([key & 7 == LINE, key & 7 == ALONE], [TEXTLESS, BARE], 0)
        met = np.repeat(np.bitwise_or.reduceat(flag, starts), np.diff(np.append(starts, len(key)))) if len(key) else flag
        new = (batch > last) & ((need == 0) | (met & need != 0))
        before = np.where(new, np.arange(len(key)) - start, 0)
        so_far = np.cumsum(before)
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(so_far, (so_far[at - 1] if at else 0) + most, side="right")))
            n = before[at:to]
            one = np.repeat(np.arange(at, to), n)
            two = start[one] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            fits = (need[one] == 0) | ((flag[one] | flag[two]) & need[one] != 0)
            yield pd.DataFrame({"id": ids[one[fits]], "other": ids[two[fits]]}).drop_duplicates()
            at = to

    return run


def _by_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Met pairs that may be one report; ``open_text`` where the texts decide."""
    for b in batches:
        found = []
        for sure, *row in zip(b["sure"], *(b[c + end] for end in ("", "2") for c in _HEAD)):
            one, two = dict(zip(_HEAD, row[:4])), dict(zip(_HEAD, row[4:]))
            # The keys of pages and copies are hashes: what they name is compared.
            known = sure and (one["page"] == two["page"] != "" or (one["headline"], one["whole"]) == (two["headline"], two["whole"]))
            found.append(True if known else same_so_far(two, one))
        kept = np.array([x is not False for x in found], dtype=bool)
        out = b.loc[kept, ["id", "other", "batch", "batch2", "target", "open"]]
        yield out.assign(open_text=[x is None for x in found if x is not False], headed=((b["headline"] != "") & (b["headline2"] != ""))[kept])


def _by_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [same_text(old.split(), new.split(), headed) for new, old, headed in zip(b["body"], b["body2"], b["headed"])]
        yield b.loc[np.array(keep, dtype=bool), ["id", "batch", "batch2", "target", "open"]]


_EDGE = "id long, batch int, batch2 int, target struct<batch:int,id:bigint>, open boolean"


def link_to_first(edges: DataFrame) -> DataFrame:
    """(id, first, first_batch): from ``edges`` to earlier records of the same report to the first record of each chain.

    ``target``: batch and id of the earlier record, or of the accepted one that it repeats; ``open`` where it is one of
    the batches accepted now, which may repeat another one itself.  What was met in earlier batches counts before what
    was met in the record's own, of which the first counts.  Each round also follows what is known of the first record
    so far, so chains are followed by doubled steps.
    """
    w = Window.partitionBy("id")
    ways = edges.withColumn("past", F.max(F.col("batch2") < F.col("batch")).over(w)).withColumn("least", F.min("target").over(w))
    ways = cut(ways.where(F.when(F.col("past"), F.col("batch2") < F.col("batch")).otherwise(F.col("target") == F.col("least"))).select("id", "target", "open"))
    first = cut(ways.groupBy("id").agg(F.min("target").alias("first")))
    onward = ways.where("open").select("id", F.col("target.id").alias("at"))
    while True:
        known = first.select(F.col("id").alias("at"), F.col("first").alias("least"))
        steps = onward.unionByName(first.select("id", F.col("first.id").alias("at"))).join(known, "at").groupBy("id").agg(F.min("least").alias("least"))
        moved = cut(first.join(steps, "id").where(F.col("least") < F.col("first")).select("id", "least"))
        if moved.isEmpty():
            return first.select("id", F.col("first.id").alias("first"), F.col("first.batch").alias("first_batch"))
        first = cut(first.join(moved, "id", "left").select("id", F.coalesce("least", "first").alias("first")))


class AcceptedHistory:
    """Accepted records as persisted runs of sorted keys and of texts; ``accept`` adds a batch and tells its duplicates.

    The state lies in ``folder``: the runs, and a manifest per accepted batch that names those that count.  Runs of an
    interrupted batch are in no manifest, so it is simply accepted again; another session goes on with the same folder.
    ``range_rows``: keys of a range; ``most_ids``: ids of met records up to which they are broadcast to the texts.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan: int = 4, range_rows: int = 250_000, most_ids: int = 200_000):
        self.spark, self.fan, self.range_rows, self.most_ids = spark, fan, range_rows, most_ids
        self.folder = folder or scratch_path(spark, "history")
        self.state = {"runs": [], "ranges": 1, "last": -1, "accepted": 0}
        self.made: set[str] = set()
        self._resume()

    @property
    def runs(self) -> list[dict]:
        return self.state["runs"]

    # The folder

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _resume(self) -> None:
        """The state of the last manifest, if there is one."""
        fs, path = self._path("manifest")
        if not fs.exists(path):
            return
        number = max(int(f.getPath().getName()) for f in fs.listStatus(path))
        self.state = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifest/{number:06d}").collect()))
        for run in self.runs:
            for name, by in ((run["keys"], "range"), (run["records"], "slot")):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.folder}/{name}").schema)
                self.spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({by}) into {self.state['ranges']} buckets location '{self.folder}/{name}'")

    def _remember(self, runs: list[dict], batch: int) -> None:
        used = {r[what] for r in runs for what in ("keys", "records")}
        gone = ({r[what] for r in self.runs for what in ("keys", "records")} | self.made) - used
        self.state |= {"runs": runs, "last": batch, "accepted": self.state["accepted"] + 1}
        fs, path = self._path(f"manifest/{self.state['accepted']:06d}")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        for name in gone:
            self._delete(name)
        self.made = set()

    def _delete(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        fs, path = self._path(name)
        fs.delete(path, True)

    def _write(self, df: DataFrame, by: str, sort: list[str]) -> str:
        """A bucketed, sorted table of the folder; its name."""
        name, n = f"{by}_{uuid.uuid4().hex}", self.state["ranges"]
        self.made.add(name)
        df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(by, *sort).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _read(self, what: str, runs: list[dict], touched: list[int] | None = None) -> DataFrame:
        """Rows of the runs; of the touched buckets only, if those are given."""
        by = {"keys": "range", "records": "slot"}[what]
        parts = [self.spark.table(r[what]) if touched is None else self.spark.table(r[what]).where(F.col(by).isin(touched)) for r in runs]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # Ranges

    def _cut_ranges(self, keys: int) -> None:
        self.state["ranges"] = max(self.spark.sparkContext.defaultParallelism, keys // self.range_rows + 1)

    def _range(self, key: str = "key") -> Column:
        """The range of a key: ranges have the same width, as keys are hashes."""
        return F.expr(f"cast(shiftrightunsigned({key}, 1) div {(1 << 63) // self.state['ranges'] + 1} as int)")

    def _slot(self, c: str) -> Column:
        return F.pmod(F.hash(c), F.lit(self.state["ranges"]))

    # Search

    def _keys(self, fresh: DataFrame, c: str) -> DataFrame:
        keys = fresh.select(F.explode(c).alias("key"), "batch", "id", "flag")
        return keys.select(self._range().alias("range"), "key", "batch", "id", "flag")

    def _touched(self, fresh: DataFrame, c: str, keys: int) -> list[int] | None:
        """The ranges of a batch's keys; None for all, which many uniform keys touch anyway."""
        if keys > 8 * self.state["ranges"]:
            return None
        return [r[0] for r in self._keys(fresh, c).select("range").distinct().collect()]

    def _first_of_key(self, rows: DataFrame) -> DataFrame:
        """(key, id, other): the first record of each new record's key, where that is another one."""
        first = F.min(F.struct("batch", "id")).over(Window.partitionBy("range", "key"))
        return rows.withColumn("first", first).where((F.col("batch") > self.state["last"]) & (F.col("first.id") != F.col("id"))).select("key", "id", F.col("first.id").alias("other"))

    def _known(self, met: DataFrame, fresh: DataFrame) -> DataFrame:
        """The records that were met, with what they repeat themselves; rows of the touched buckets only are read.

        ``target``: batch and id of the record, or of the accepted one that it repeats; ``open`` if it is of these batches.
        """
        light = fresh.select("id", "batch", *_HEAD, "body", F.struct("batch", "id").alias("target"), F.lit(True).alias("open"))
        if not self.runs:
            return light
        ids = met.select(F.col("other").alias("id")).distinct()
        asked = met.agg(F.count(F.lit(1)), F.collect_set(self._slot("other"))).first()
        past = self._read("records", self.runs, sorted(asked[1])).join(F.broadcast(ids) if asked[0] <= self.most_ids else ids.hint("merge"), "id", "left_semi")
        target = F.struct(F.coalesce("first_batch", "batch").alias("batch"), F.coalesce("first", "id").alias("id"))
        return light.unionByName(past.select("id", "batch", *_HEAD, "body", target.alias("target"), F.lit(False).alias("open")))

    def _same(self, met: DataFrame, fresh: DataFrame) -> DataFrame:
        """Edges from new records to the met ones (id, other, sure) that carry the same report."""
        tasks = max(self.spark.sparkContext.defaultParallelism, 8)
        there = self._known(met, fresh).select(F.col("id").alias("other"), F.col("batch").alias("batch2"), "target", "open", *[F.col(c).alias(f"{c}2") for c in _HEAD])
        pairs = met.join(there.hint("merge"), "other").join(fresh.select("id", "batch", *_HEAD).hint("merge"), "id")
        near = cut(pairs.repartition(tasks, "id", "other").mapInPandas(_by_head, f"{_EDGE.replace('id long,', 'id long, other long,', 1)}, open_text boolean, headed boolean"))
        texts = self._known(near.where("open_text"), fresh).select(F.col("id").alias("other"), F.col("body").alias("body2"))
        asked = near.where("open_text").join(texts.hint("merge"), "other").join(fresh.select("id", "body").hint("merge"), "id")
        read = asked.repartition(tasks, "id", "other").mapInPandas(_by_text, _EDGE)
        return near.where("not open_text").select("id", "batch", "batch2", "target", "open").unionByName(read)

    def accept(self, records: DataFrame, batch: int) -> DataFrame:
        """(id, first) of the batch's records that repeat an accepted one or an earlier one of the batch.

        ``records``: id, url, title, text; batch numbers rise.
        """
        asked = records.select("id", F.lit(batch).alias("batch"), "url", "title", "text")
        return self.accept_described(cut(describe(spread(asked))), [batch])

    def accept_described(self, fresh: DataFrame, batches: list[int]) -> DataFrame:
        """As ``accept``, for the rows of ``describe`` of batches that wait together; ``fresh`` is read several times."""
        if min(batches) <= self.state["last"]:
            raise ValueError(f"batch {min(batches)} comes after {self.state['last']}")
        facts = fresh.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in ("sure", "marks")]).first()
        if not self.runs:
            self._cut_ranges(facts[1] + facts[2])
        sure = self._keys(fresh, "sure")
        known = sure
        if self.runs:
            past = self._read("keys", self.runs, self._touched(fresh, "sure", facts[1]))
            known = sure.repartition(self.state["ranges"], "range").unionByName(past.where(F.col("key").bitwiseAND(7) <= COPY))
        first = cut(self._first_of_key(known))
        copies = first.where(F.col("key").bitwiseAND(7) == COPY).select("id")
        others = fresh.select("id", "batch", "flag", "marks").join(copies, "id", "left_anti")
        run = {"keys": self._write(sure.unionByName(self._keys(others, "marks")), "range", ["key", "batch", "id"]), "rows": facts[0], "key_rows": facts[1] + facts[2]}
        all_runs = [*self.runs, run]
        marks = self._read("keys", all_runs, self._touched(fresh, "marks", facts[2])).where(F.col("key").bitwiseAND(7) > COPY)
        marked = marks.groupBy("range").applyInPandas(_pairs(self.state["last"]), "id long, other long")
        met = marked.select("id", "other", F.lit(False).alias("sure")).unionByName(first.select("id", "other", F.lit(True).alias("sure")))
        met = cut(met.groupBy("id", "other").agg(F.max("sure").alias("sure")))
        found = link_to_first(self._same(met, fresh))
        texts = fresh.select("id", "batch", *_HEAD, "body").join(found, "id", "left").withColumn("slot", self._slot("id"))
        run["records"] = self._write(texts, "slot", ["id"])
        self._remember(self._compact(all_runs), max(batches))
        self._tidy()
        return found.select("id", "first")

    def _tidy(self) -> None:
        """What has been shuffled and broadcast is cleaned up when the driver's references to it are collected."""
        self.spark.sparkContext._jvm.System.gc()

    def _compact(self, runs: list[dict]) -> list[dict]:
        """Runs of one order of size merged into one, from the smallest; all of them, cut anew, when ranges have grown."""
        level = lambda r: int(np.log(max(r["rows"], 1)) / np.log(self.fan))
        while full := sorted(k for k, n in Counter(map(level, runs)).items() if n >= self.fan):
            keys = sum(r["key_rows"] for r in runs)
            anew = keys > 2 * self.range_rows * self.state["ranges"]
            merged = [r for r in runs if anew or level(r) == full[0]]
            rows, texts = self._read("keys", merged), self._read("records", merged)
            if anew:
                self._cut_ranges(keys)
                rows, texts = rows.withColumn("range", self._range()), texts.withColumn("slot", self._slot("id"))
            one = {"keys": self._write(rows, "range", ["key", "batch", "id"]), "rows": sum(r["rows"] for r in merged), "key_rows": sum(r["key_rows"] for r in merged), "records": self._write(texts, "slot", ["id"])}
            runs = [r for r in runs if r not in merged] + [one]
        return runs


def duplicates(records: DataFrame, window: int = 10, folder: str | None = None, **layout: int) -> DataFrame:
    """(id, first) over all records (id, batch, url, title, text), each against those before it by batch and id.

    The first batch is accepted as the history, and the batches that wait behind it are merged into it together.  All are
    described at once.  ``window`` is taken from callers and bounds nothing: an equal key's neighbourhood is met in full.
    """
    spark = records.sparkSession
    numbers = sorted(r[0] for r in records.select("batch").distinct().collect())  # numbers of batches only
    store, found, path = AcceptedHistory(spark, folder, **layout), None, scratch_path(spark, "described")
    describe(spread(records)).withColumn("waits", F.col("batch") > (numbers[0] if numbers else 0)).write.partitionBy("waits").parquet(path)
    for waits, batches in ((False, numbers[:1]), (True, numbers[1:])):
        if batches:
            now = store.accept_described(spark.read.parquet(path).where(F.col("waits") == waits), batches)
            found = now if found is None else found.unionByName(now)
    return found if found is not None else spark.createDataFrame([], "id long, first long")
