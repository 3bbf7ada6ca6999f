"""All registered queries of the market-research operators and their SQL."""

from __future__ import annotations

from .plans import windows  # noqa: F401, I001  (first: others use its SQL)
from .plans import aggregates, joins, research, streams  # noqa: F401
from .plans import banks, decisions, embedding, evidence, experiments, intraday, matrices, observations, portfolio, provenance, reports, selection, sources, swing, validation  # noqa: F401, I001  (last: they use the SQL of the others)
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "gap_event_ledger"
