"""Problem 9: sources mixed to target shares of all tokens.

A classifier fitted on the labelled table gives every document a soft membership in the target domains: where its source is
known, that source's domain alone (or none of them); where it is not, the posterior of each domain given its text.  Rates
of nonnegative use per document then follow from least squares on the domains' expected token totals.  Documents of one
cell (domains with the highest posteriors, in tenths, and cap) get one rate, so projected gradient runs over the cells,
whose expected totals are exact sums over their documents' own posteriors, made in one distributed aggregation.  Rates
become whole uses by systematic rounding along a hash order, cut into many strips so that no order runs through one task.

The target size is the largest for which no domain needs more than its documents at their caps give, so all shares
can be met.  Sizes are tokens of a public tokenizer, whose file is a parameter.

Defined results: documents without text or tokens are never used, nor are those of a known source without target; null
and blank sources are unknown; a source without documents gets nothing and its share is reported as missed; targets of
the same source add up, with the lowest cap.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.languages import bounded_sample
from tidewatch.session import cut

TOKENIZER = os.environ.get("TIDEWATCH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: How the tokenizer splits text before its merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = re.compile(r"[^\W_]+")
BUCKETS = 4096


@cache
def tokenizer(path: str):
    """The tokenizer of a rank file; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("tidewatch", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _features(text: str) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(w) % BUCKETS for w in _WORD.findall(text.casefold())], dtype=np.int64)


class DomainClassifier:
    """Multinomial naive Bayes over hashed words."""

    def __init__(self, domains: list[str], sample: list[tuple[str, str]]):
        self.domains = domains
        counts = np.full((len(domains), BUCKETS), 0.1)
        prior = np.ones(len(domains))
        at = {d: i for i, d in enumerate(domains)}
        for domain, text in sample:
            np.add.at(counts[at[domain]], _features(text), 1.0)
            prior[at[domain]] += 1
        self.table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log(prior / prior.sum())

    def posterior(self, text: str) -> np.ndarray:
        score = self.prior + self.table[:, _features(text)].sum(axis=1)
        like = np.exp(score - score.max())
        return like / like.sum()


def fit_domains(documents: DataFrame, domains: list[str], sample_rows: int = 4000) -> DomainClassifier:
    """A classifier from at most ``sample_rows`` documents of the domains, those with the lowest hash."""
    known = documents.where(F.col("source").isin(domains) & (F.length("text") > 0)).select("source", "text")
    return DomainClassifier(domains, bounded_sample(known, ["source", "text"], sample_rows))


def _cell(weights: np.ndarray) -> int:
    """Code of a membership: the two leading domains and the tenths of the first; at most ten times their pairs."""
    first, second = np.argsort(-weights, kind="stable")[[0, min(1, len(weights) - 1)]]
    return int((first * len(weights) + second) * 11 + int(weights[first] * 10)) if weights[first] < 1 else -1 - int(first)


def _weigh(shared, path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: DomainClassifier = shared.value
        encode = tokenizer(path)
        known = dict(zip(model.domains, np.eye(len(model.domains))))
        for b in batches:
            tokens = [len(x) for x in encode.encode_ordinary_batch(b["text"].tolist(), num_threads=1)]
            weights = [known[source] if source in known else model.posterior(text) for source, text in zip(b["source"], b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": tokens, "weights": weights, "cell": [_cell(w) for w in weights]})

    return run


def fit_rates(mass: np.ndarray, caps: np.ndarray, shares: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Rate of each cell by projected gradient: nonnegative, at most its cap, expected domain totals at the target.

    ``mass``: expected tokens of each domain in each cell at rate 1.  The size is the largest the caps allow for all shares.
    """
    most = (mass * caps[:, None]).sum(axis=0)
    wanted = shares > 0
    reachable = wanted & (most > 0)
    if not reachable.any():
        return np.zeros(len(mass))
    size = (most[reachable] / shares[reachable]).min()
    target = np.where(reachable, shares * size, 0.0)
    scale = 1.0 / max(target.max(), 1.0)
    a = mass * scale
    goal = target * scale
    # Cells differ in size by orders of magnitude: each rate is stepped in units of its own cell.
    unit = np.maximum(np.abs(a).sum(axis=1), 1e-12)
    step = 1.0 / np.linalg.norm(a / unit[:, None], 2) ** 2
    rate, momentum, t = np.zeros(len(mass)), np.zeros(len(mass)), 1.0
    for _ in range(steps):
        slope = (a / unit[:, None]) @ (a.T @ momentum - goal)
        moved = np.clip(momentum - step * slope / unit, 0.0, caps)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = moved + (t - 1) / t_next * (moved - rate)
        if np.abs(moved - rate).max() < 1e-12:
            return moved
        rate, t = moved, t_next
    return rate


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, strip_rows: int = 50_000) -> DataFrame:
    """(doc_id, source, tokens, uses, weights): how often each document is used, at least once, and its membership."""
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    goals = sorted((r["source"], r["share"], max(int(r["cap"] if r["cap"] is not None else 1), 0)) for r in wanted.collect())
    domains = [g[0] for g in goals]
    spark = documents.sparkSession
    source = F.when(F.trim("source") != "", F.col("source"))
    docs = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text")
    docs = docs.where(F.col("source").isNull() | F.col("source").isin(domains))
    if not domains:
        return docs.select("doc_id", "source", F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("uses"), F.array().cast("array<double>").alias("weights")).limit(0)
    model = fit_domains(documents, domains)
    weighed = docs.mapInPandas(_weigh(spark.sparkContext.broadcast(model), path), "doc_id long, source string, tokens long, weights array<double>, cell int")
    # A document of unknown source is used as often as the least cap allows.
    cap_of = F.create_map(*[F.lit(x) for d, _, c in goals for x in (d, c)])
    capped = cut(weighed.where("tokens > 0").withColumn("cap", F.coalesce(F.try_element_at(cap_of, "source"), F.lit(min(c for _, _, c in goals)))))
    mass = [F.sum(F.col("tokens") * F.col("weights")[k]).alias(f"m{k}") for k in range(len(domains))]
    cells = capped.groupBy("cell", "cap").agg(F.count(F.lit(1)).alias("rows"), *mass).orderBy("cap", "cell").collect()
    if not cells:
        return capped.select("doc_id", "source", "tokens", F.lit(0).alias("uses"), "weights").limit(0)
    shares = np.array([s for _, s, _ in goals])
    rates = fit_rates(np.array([[c[f"m{k}"] for k in range(len(domains))] for c in cells], float), np.array([c["cap"] for c in cells], float), shares / shares.sum())
    plan = [(c["cell"], c["cap"], float(r), 1 + c["rows"] // strip_rows) for c, r in zip(cells, rates)]
    rate = spark.createDataFrame(plan, "cell int, cap int, rate double, strips long")
    rated = capped.join(F.broadcast(rate), ["cell", "cap"])  # one row per cell
    # Systematic rounding by tokens within strips of about strip_rows documents of one cell, drawn by hash.
    strip = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("strips"))
    turned = rated.select("doc_id", "source", "tokens", "weights", "cap", "rate", strip.alias("strip"), "cell", F.xxhash64("doc_id").alias("turn"))
    return turned.groupBy("cell", "cap", "strip").applyInPandas(_whole_uses, "doc_id long, source string, tokens long, uses int, weights array<double>").where("uses > 0")


def _whole_uses(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("turn", kind="stable")
    tokens, rate, cap = pdf["tokens"].to_numpy(float), float(pdf["rate"].iloc[0]), int(pdf["cap"].iloc[0])
    base = np.floor(rate + 1e-9)
    due = np.cumsum(tokens) * max(rate - base, 0.0)
    given, extra = 0.0, np.zeros(len(pdf), dtype=int)
    for i, n in enumerate(tokens):  # whichever choice leaves the smaller debt
        if base < cap and abs(given + n - due[i]) < abs(given - due[i]):
            extra[i], given = 1, given + n
    return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": pdf["tokens"], "uses": (base + extra).astype(int), "weights": pdf["weights"]})


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, documents, uses, actual_share, expected_share): what a selection of ``mix`` reaches.

    ``actual_share`` counts documents by their source, null where that is unknown; ``expected_share`` by their membership.
    """
    names = sorted(r[0] for r in targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select("source").distinct().collect())
    size = F.col("tokens") * F.col("uses")
    used = selection.groupBy("source").agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"))
    member = selection.select(F.posexplode("weights").alias("k", "w"), size.alias("size")).groupBy("k").agg(F.sum(F.col("w") * F.col("size")).alias("expected"))
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("k")) if names else F.lit(None).cast("string")
    whole = used.agg(F.sum("tokens").alias("all_tokens"))
    goals = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    joined = goals.join(used, goals["source"].eqNullSafe(used["source"]), "full").select(F.coalesce(goals["source"], used["source"]).alias("source"), "target_share", "tokens", "documents", "uses")
    joined = joined.join(member.select(named.alias("source"), "expected"), "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda c, name: F.coalesce(F.try_divide(F.col(c), F.col("all_tokens")), F.lit(0.0)).alias(name)
    return joined.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("tokens"), zero("documents"), zero("uses"), share("tokens", "actual_share"), share("expected", "expected_share"))
