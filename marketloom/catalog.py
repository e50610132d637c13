"""All queries of the engine: importing this module registers them."""

from __future__ import annotations

from marketloom.plans import books, contracts, evaluation, evidence, families, indicators, ledger, memos, options, panel, portfolio, records, rollups, signals, stats, streams, universe  # noqa: F401
from marketloom.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
