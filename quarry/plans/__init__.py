"""Registered queries of the knowledge-base operators."""

from . import corpus, dashboard, feedback, relational, retrieval, routes, sessions, streams, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "dashboard", "feedback", "relational", "retrieval", "routes", "sessions", "streams", "texts"]
