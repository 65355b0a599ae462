"""Registry of the queries of this subpackage with their SQL oracles."""

from __future__ import annotations

from kumiki.llm import copy_queries, neardup_queries, pair_queries, survivor_queries, token_queries, topic_queries, visual_queries

MODULES = [copy_queries, neardup_queries, pair_queries, survivor_queries, token_queries, topic_queries, visual_queries]
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
