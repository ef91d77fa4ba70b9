"""Registered queries: every operator on the benchmark tables, with its SQL counterpart."""

from opslattice.catalog import (  # noqa: F401
    aggregates, audits, detectors, evaluations, graphs, joins, parsing, rankings, reports, series, storage,
)
from opslattice.catalog.base import ORACLES, QUERIES  # noqa: F401
