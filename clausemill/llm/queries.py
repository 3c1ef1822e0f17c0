"""The queries opN_<name> and their oracle SQL."""

from __future__ import annotations

from clausemill.llm.oracles import ORACLES
from clausemill.llm import query_chat, query_decontaminate, query_html, query_jaccard, query_lines, query_names, query_packing, query_pii, query_quality, query_repair, query_tokens, query_vectors, query_warc

QUERIES = {**query_quality.QUERIES, **query_chat.QUERIES, **query_packing.QUERIES, **query_decontaminate.QUERIES, **query_jaccard.QUERIES, **query_pii.QUERIES, **query_html.QUERIES, **query_lines.QUERIES, **query_tokens.QUERIES, **query_warc.QUERIES, **query_repair.QUERIES, **query_names.QUERIES, **query_vectors.QUERIES}

__all__ = ["ORACLES", "QUERIES"]
