"""Named queries over the standard tables, and for each the SQL that states its result."""

from . import aggregates, answers, evidence, filters, graphs, identifiers, joins, landings, ledgers, mentions, paging, resolution, searches, stages, states, texts, triples
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "answers", "evidence", "filters", "graphs", "identifiers", "joins", "landings", "ledgers", "mentions", "paging", "resolution", "searches", "stages", "states", "texts", "triples"]
