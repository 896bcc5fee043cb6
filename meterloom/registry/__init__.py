"""Registered queries over the shared test tables, each with its SQL counterpart.

The tables hold no assistant logs, so ``adapters`` maps ``events`` to log lines, usage rows and
quota readings; the mapping is synthetic and stated once for both sides.
"""

from meterloom.registry import quota_queries, usage_queries

QUERIES = {**usage_queries.QUERIES, **quota_queries.QUERIES}
ORACLES = {**usage_queries.ORACLES, **quota_queries.ORACLES}
