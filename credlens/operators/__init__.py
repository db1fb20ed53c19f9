"""Detectors, lexical joins, the scoring model and breach lookups."""
