"""Queries over the project's tables for the text and record operators, and their SQL."""

from __future__ import annotations

from orrery.llm import q_names, q_pairs, q_records, q_texts

_PARTS = [q_records, q_pairs, q_names, q_texts]
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _PARTS for k, v in m.ORACLE.items()}
