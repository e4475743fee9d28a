"""All queries of the engine's own operators."""

from . import corpus_queries, holding_queries, invest_queries, ledger_queries, link_queries, note_queries, pipeline_queries, report_queries, rule_queries, selection_queries, spend_queries, store_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
