"""Scans, lexicons, bindings to the supplied tables and the statistics store."""
