"""The named queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from . import layout_queries, line_queries, media_queries, page_queries, quality_queries, report_queries, source_queries, topic_queries

_PARTS = (line_queries, topic_queries, quality_queries, report_queries, layout_queries, source_queries, media_queries, page_queries)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
FLAGSHIP = "convert_topics"
