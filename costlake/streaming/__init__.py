"""Structured Streaming forms of ingest and alerting, with batch twins where they share code."""
