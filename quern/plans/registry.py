"""All registered queries of the core, with their SQL counterparts."""

from __future__ import annotations

from quern.plans import data_queries, more_queries

QUERIES = {**more_queries.QUERIES, **data_queries.QUERIES}
ORACLES = {**more_queries.ORACLES, **data_queries.ORACLES}
