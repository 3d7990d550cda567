"""All queries over the reference domain, and their SQL."""

from __future__ import annotations

from tallyframe.plans import bank_queries, document_queries, edit_queries, ledger_queries, lifecycle_queries, match_queries, page_queries, rule_queries, view_queries

FLAGSHIP = "tie_out_checks"
_PARTS = (ledger_queries, bank_queries, match_queries, document_queries, lifecycle_queries, view_queries, page_queries, edit_queries, rule_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
