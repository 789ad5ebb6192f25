"""All queries of the core library, and their oracles, by name."""

from __future__ import annotations

from tallyforge.plans import catalog, decisions, listings, mechanisms, records, rules, upkeep

_ALL = {**decisions.QUERIES, **catalog.QUERIES, **upkeep.QUERIES, **listings.QUERIES, **records.QUERIES, **mechanisms.QUERIES, **rules.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
