"""Structured Streaming: the usage ledger, windows, incremental snapshots."""
