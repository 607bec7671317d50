"""Spark jobs for transaction-monitoring alert triage."""
