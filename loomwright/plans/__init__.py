"""Composed plans: registered queries, the read path and the write path."""

from . import sink_queries, text_queries  # noqa: F401  (they add their queries to the registry)
