"""Structured Streaming forms of ingest, route health and admission."""
