"""Credential-strength analytics and corpus preparation on Spark."""
