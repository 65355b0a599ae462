"""Registry of the core queries with their SQL oracles."""

from __future__ import annotations

from kumiki.plans import attempt_queries, bank_queries, classify_queries, learner_queries, lesson_queries, lookup_queries, orphan_queries, source_queries, stream_queries, text_queries

MODULES = [attempt_queries, text_queries, bank_queries, classify_queries, learner_queries, lookup_queries, stream_queries, orphan_queries, source_queries, lesson_queries]
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
