"""All registered queries and their oracles."""

from __future__ import annotations

from questlog.plans import fact_queries, log_queries, oracle_facts, oracle_log

QUERIES = {**log_queries.QUERIES, **fact_queries.QUERIES}
ORACLES = {k: v for part in (oracle_log, oracle_facts) for k, v in part.ORACLES.items() if k in QUERIES}
