"""Imports every module of queries; QUERIES and SQL then hold them all."""

from folioflow.plans import aggregates, deep, exams, extracts, files, graph, ingest, knowledge, memory, more, relational, report, retrieval, sessions, streams, text, titles, trees, windows  # noqa: F401
from folioflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
