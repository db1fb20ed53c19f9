"""Profiles, derived statistics, reports and monitoring."""
