"""Exact double-entry ledger analytics as Spark jobs."""
