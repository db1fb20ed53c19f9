"""Incremental ingestion and per-event statistics."""
