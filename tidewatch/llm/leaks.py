"""Problem 8: evaluation texts inside a corpus.

Windows of consecutive words get a 64-bit SimHash of their words and word pairs.  Windows have ``words`` words, the
length of a passage, at every place; and the size of the item: the largest of ``sizes`` that fits into it, laid side by
side from its beginning and to its end.  A fingerprint is cut into ``radius + 1`` blocks, and two fingerprints within the
radius agree in one block at least, so a join by block finds all of them.  What meets is compared by the weighted share of
common words and word pairs; ``exact`` says whether a passage agrees word for word.

The corpus is read and fingerprinted once, however many items there are.  A bitmap of the items' blocks, whose size is
fixed by the bits of a block, goes out to the tasks; only windows with a block in it leave them and meet the items in a
shuffled join, so neither texts nor windows of items pass the driver.

Defined results: items and documents shorter than the window hold no passage; nulls likewise; repeated windows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.forms import comparable_form
from tidewatch.session import cut

_WORD = re.compile(r"[^\W_]+(?:[̀-ًͯ-ٟ]+[^\W_]*)*")


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of the comparable form."""
    return _WORD.findall(comparable_form(text) or "")


def word_codes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64-bit codes of the words; ``known`` remembers them between calls."""
    if len(known) > 400_000:
        known.clear()
    return np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words_of(text)], dtype=np.uint64)


def _bits(codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits."""
    return (np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1) * 2 - 1).view(np.int8)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Codes of neighbouring words."""
    with np.errstate(over="ignore"):
        x = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (codes[1:] ^ (codes[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def window_prints(codes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Per size the SimHash of every window of so many words: its words and pairs, each with weight 1."""
    if not len(codes):
        return [np.zeros(0, dtype=np.uint64) for _ in sizes]
    # Sums run over all of it and wrap around; those of a window, up to twice its words, come out right.
    kind = np.int8 if max(sizes) <= 63 else np.int16
    last = _bits(_pairs(codes)).astype(kind, copy=False)
    each = _bits(codes).astype(kind)
    each[:-1] += last  # a word with the pair that it begins
    one = np.zeros((len(codes) + 1, 64), kind)
    np.cumsum(each, axis=0, dtype=kind, out=one[1:])
    out = []
    for words in sizes:
        n = len(codes) - words + 1
        if n <= 0:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        total = one[words : words + n] - one[:n]
        total[: len(last) - words + 1] -= last[words - 1 :]  # but for the pair that leads out of the window
        out.append(np.packbits(total > 0, axis=1).view("<u8").ravel())
    return out


def block_masks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks that make up 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two windows' words and word pairs; weights are how often each occurs."""
    ka, na = np.unique(np.concatenate([a, _pairs(a)]), return_counts=True)
    kb, nb = np.unique(np.concatenate([b, _pairs(b)]), return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(na[ia], nb[ib]).sum()
    return float(both / (na.sum() + nb.sum() - both))


def item_places(n: int, words: int, sizes: tuple[int, ...]) -> list[tuple[int, int]]:
    """(size, place) of an item's windows: every place of the passage's size, and item-sized ones side by side."""
    out = [(words, at) for at in range(n - words + 1)]
    size = max((s for s in sizes if words < s <= n), default=0)
    return out + [(size, at) for at in sorted({*range(0, n - size + 1, size), n - size})] if size else out


def _first_block(radius: int) -> Column:
    """The first block in which ``print`` and ``print_i`` agree."""
    apart = F.col("print").bitwiseXOR(F.col("print_i"))
    return F.coalesce(*[F.when(F.shiftrightunsigned(apart, shift).bitwiseAND(F.lit(mask)) == 0, k) for k, (shift, mask) in enumerate(block_masks(radius))])


_WINDOW = "size int, print long, codes binary"


def _item_windows(words: int, sizes: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["text"]):
                codes = word_codes(text, known)
                prints = dict(zip((words, *sizes), window_prints(codes, words, *sizes)))
                rows += [(item, size, int(prints[size][at].view(np.int64)), codes[at : at + size].tobytes()) for size, at in item_places(len(codes), words, sizes)]
            yield pd.DataFrame(rows, columns=["item_id", "size", "print", "codes"])

    return run


class _Sieve:
    """Which blocks of fingerprints any item has: for every size and block a bitmap of its lowest ``bits`` bits."""

    def __init__(self, radius: dict[int, int], bits: int):
        self.radius, self.bits, self.seen = radius, bits, {}

    def fill(self, size: int, block: int, bucket: int, bitmap: bytes) -> None:
        seen = self.seen.setdefault((size, block), np.zeros(1 << self.bits, dtype=bool))
        part = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little")
        end = min(len(seen), (bucket + 1) * len(part))
        seen[bucket * len(part) : end] |= part[: end - bucket * len(part)].astype(bool)

    def passing(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, places, keys) of the fingerprints whose block some item may have."""
        for block, (shift, mask) in enumerate(block_masks(self.radius[size])):
            if (size, block) in self.seen:
                keys = (prints >> np.uint64(shift)) & np.uint64(mask)
                at = np.flatnonzero(self.seen[size, block][(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
                yield block, at, keys[at]


def _scan(shared, chunk: int = 20_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve, known = shared.value, {}
        sizes = sorted({size for size, _ in sieve.seen})

        def met(ids: list[int], texts: list[np.ndarray]) -> list[tuple]:
            """Texts one behind the other are fingerprinted together; windows that reach over an end don't count."""
            codes, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            rows = []
            for size, prints in zip(sizes, window_prints(codes, *sizes)):
                for block, at, keys in sieve.passing(size, prints):
                    inside = at + size <= ends[owner[at]]
                    for k, key in zip(at[inside].tolist(), keys[inside].tolist()):
                        text = owner[k]
                        rows.append((ids[text], k - int(ends[text]) + len(texts[text]), size, block, key, int(prints[k].view(np.int64)), codes[k : k + size].tobytes()))
            return rows

        columns = ["doc_id", "position", "size", "block", "key", "print", "codes"]
        for b in batches:
            ids, texts, n = [], [], 0
            for doc, text in zip(b["doc_id"].tolist(), b["text"]):
                codes = word_codes(text, known)
                if sizes and len(codes) >= sizes[0]:
                    ids.append(doc)
                    texts.append(codes)
                    n += len(codes)
                if n >= chunk:
                    yield pd.DataFrame(met(ids, texts), columns=columns)
                    ids, texts, n = [], [], 0
            if texts:
                yield pd.DataFrame(met(ids, texts), columns=columns)

    return run


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        alike = [1.0 if x == y else weighted_similarity(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b["codes"], b["codes_i"])]
        yield b[["doc_id", "item_id", "position", "size"]].assign(similarity=alike, exact=(b["codes"] == b["codes_i"]).astype(bool))


def find_leaks(documents: DataFrame, items: DataFrame, words: int = 12, radius: int = 2, sizes: tuple[int, ...] = (24, 48), item_radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, position, size, similarity, exact): the best passage of each item in each document.

    ``radius`` holds for windows of ``words`` words, ``item_radius`` for item-sized ones.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    asked = items.select(F.col("item_id").cast("int").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    windows = cut(asked.mapInPandas(_item_windows(words, sizes), f"item_id int, {_WINDOW}").distinct())
    reach, bits = {words: radius} | dict.fromkeys(sizes, item_radius), 22

    def blocks(size: int) -> Column:
        parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", shift).bitwiseAND(F.lit(mask)).alias("key")) for k, (shift, mask) in enumerate(block_masks(reach[size]))]
        return F.array(*parts)

    by_size = F.coalesce(*[F.when(F.col("size") == size, blocks(size)) for size in reach])
    keyed = windows.withColumn("b", F.explode(by_size)).select("item_id", "size", "b.block", "b.key", F.col("print").alias("print_i"), F.col("codes").alias("codes_i"))
    low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    # Bitmaps of 32,768 bits each: at most 128 for each block of a size.
    maps = keyed.groupBy("size", "block", (F.bitmap_bucket_number(low + 1) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low + 1)).alias("bitmap"))
    sieve = _Sieve(reach, bits)
    for row in maps.collect():
        sieve.fill(*row)
    passed = docs.mapInPandas(_scan(spark.sparkContext.broadcast(sieve)), "doc_id long, position int, size int, block int, key long, print long, codes binary")
    met = passed.join(keyed, ["size", "block", "key"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("print_i"))) <= F.when(F.col("size") == words, radius).otherwise(item_radius))
    # A pair of windows may agree in several blocks: it counts under the first.
    met = met.where(F.col("block") == F.when(F.col("size") == words, _first_block(radius)).otherwise(_first_block(item_radius)))
    found = met.select("doc_id", "item_id", "position", "size", "codes", "codes_i").mapInPandas(_compare, "doc_id long, item_id int, position int, size int, similarity double, exact boolean")
    best = F.max(F.struct("exact", "similarity", "size", F.negative("position").alias("back"))).alias("x")
    return found.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.negative("x.back").alias("position"), "x.size", "x.similarity", "x.exact")
