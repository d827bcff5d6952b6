"""Conditional scores of records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch.functions.terms import class_hits


def completeness(has_date: Column, author: Column, text: Column, title: Column, confidence: Column) -> Column:
    """Mean of five parts between 0 and 1."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    length = F.least(F.lit(1.0), F.length(F.coalesce(text, F.lit(""))) / 200.0)
    title_part = F.when(F.length(F.coalesce(title, F.lit(""))).between(15, 300), 1.0).otherwise(0.5)
    return (flag(has_date) + flag(F.coalesce(author, F.lit("")) != "") + length + title_part + F.coalesce(confidence, F.lit(0.0))) / 5


def health(failures: Column) -> Column:
    """State of a feed by its failures in a row."""
    return F.when(failures == 0, "healthy").when(failures < 3, "degraded").otherwise("failed")


def fetch_class(status: Column) -> Column:
    """Class of an HTTP status."""
    return (
        F.when(status.between(200, 299), "ok").when(status == 304, "unchanged").when(status == 429, "rate_limited").when(status.isin(401, 403, 451), "blocked")
        .when(status.isin(404, 410), "gone").when(status.isin(408, 425) | (status >= 500), "retry").when(status.isNull(), "unreachable").otherwise("failed")
    )


# Points of a source's influence by the level of each indicator.
INFLUENCE_POINTS = {
    "frequency": {"daily": 25, "weekly": 15, "monthly": 8, "occasional": 0},
    "regional_importance": {"high": 15, "medium": 8, "low": 0},
    "cited_by_other_media": {"high": 10, "medium": 5, "low": 0},
    "historical_importance": {"high": 10, "medium": 5, "low": 0},
}
# What repeats the rank of an institution (tier B) and doesn't count there; fewest indicators of a score.
NOT_FOR_TIER_B, LEAST_INDICATORS = ("regional_importance", "historical_importance"), 2


def audience_points(value: Column) -> Column:
    """Points for the largest sourced audience: ten per power of ten above a thousand, 0 to 40; null without one."""
    return F.when(value > 0, F.round(F.least(F.greatest((F.log10(value) - 3) * 10, F.lit(0.0)), F.lit(40.0)), 1))


def influence(audience: Column, levels: dict[str, Column], tier: Column) -> Column:
    """Influence of a source, 0 to 100 (C3), from its audience and the levels of ``INFLUENCE_POINTS``.

    Null without an audience, and from the audience alone: it is one of the two indicators that a score takes.
    """
    scored = [audience_points(audience)]
    for name, level in levels.items():
        table = F.create_map(*[F.lit(x) for k, v in INFLUENCE_POINTS[name].items() for x in (k, float(v))])
        points = F.try_element_at(table, F.lower(level))
        scored.append(F.when(~tier.eqNullSafe("B"), points) if name in NOT_FOR_TIER_B else points)
    given = F.array_compact(F.array(*scored))
    total = F.aggregate(given, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(scored[0].isNotNull() & (F.size(given) >= LEAST_INDICATORS), F.round(total, 1))


def trend_status(growth: Column, recent: Column, previous: Column, sources: Column) -> Column:
    """Emerging, declining or stable."""
    return F.when((growth >= 1) & (recent >= 5) & (sources >= 3), "emerging").when((growth <= -0.5) & (previous >= 5), "declining").otherwise("stable")


def run_status(failed: Column, done: Column) -> Column:
    """Status of a run by its failed and finished stages."""
    return F.when((failed > 0) & (done == 0), "failed").when(failed > 0, "partial").otherwise("success")


def relevance(title: Column, summary: Column, strong: list[str], weak: list[str]) -> Column:
    """Relevance by terms (F9): a strong term in the title 1, in the summary .8, a weak one anywhere .4."""
    terms = {"strong": strong, "weak": weak}
    t, s = class_hits(F.coalesce(title, F.lit("")), terms), class_hits(F.coalesce(summary, F.lit("")), terms)
    return F.when(t[0] > 0, 1.0).when(s[0] > 0, 0.8).when((t[1] > 0) | (s[1] > 0), 0.4).otherwise(0.0)


def record_problems(checks: dict[str, Column]) -> Column:
    """The names of the checks a record fails, in their order (C4)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def with_default(value: Column, by: Column, defaults: dict[str, str], otherwise: str) -> Column:
    """A blank value's default by another attribute, such as the content type of a kind of source."""
    table = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.coalesce(F.when(F.trim(value) != "", value), F.try_element_at(table, by), F.lit(otherwise))


def one_of(value: Column, allowed: list[str]) -> Column:
    """A check of ``record_problems``: the value is there and one of those allowed."""
    return F.coalesce(value.isin(*allowed), F.lit(False))


def only_with(claim: Column, evidence: Column) -> Column:
    """A check of ``record_problems``: a claim stands only with evidence."""
    return claim.isNull() | (F.coalesce(F.trim(evidence), F.lit("")) != "")
