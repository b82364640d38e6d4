"""All registered queries of the engine and their SQL."""

from . import detail, doors, evidence, kpi, queries, reports, simulate, streams, wider  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
