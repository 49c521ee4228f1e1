"""Mutual-fund ledger analytics as Spark DataFrame operators."""
