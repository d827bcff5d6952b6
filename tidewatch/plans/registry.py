"""All queries of the core library and their SQL."""

from __future__ import annotations

from tidewatch.plans import administration, analysis, catalog, ingest, metrics, problems, profiles, search, stories  # noqa: F401

QUERIES = {**problems.QUERIES, **catalog.QUERIES}
ORACLES = {**problems.ORACLES, **catalog.ORACLES}
